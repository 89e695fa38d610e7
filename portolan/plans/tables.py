"""What a table should look like: columns, keys, indexes; type mapping and schema plans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnSpec:
    """A column by its database type; the default is put where a written row has null."""

    name: str
    type: str
    cast: str | None = None
    unsigned: bool = False
    default: object = None
    nullable: bool = True


@dataclass(frozen=True)
class IndexSpec:
    """kind: plain, desc, json, json_key, covering, trigram, partial, full_text, prefix or vector."""

    name: str
    columns: tuple[str, ...]
    kind: str = "plain"
    include: tuple[str, ...] = ()
    where: str | None = None
    directions: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...] = ()
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[str, str], ...] = ()  # (column, table)
    indexes: tuple[IndexSpec, ...] = field(default=())

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    def with_index(self, index: IndexSpec) -> TableSpec:
        if any(i.name == index.name for i in self.indexes):
            raise ValueError(f"{self.name} has an index {index.name} already")
        if any(d not in ("asc", "desc") for d in index.directions):
            raise ValueError("an index's directions are asc or desc")
        return TableSpec(self.name, self.columns, self.key, self.unique, self.references, (*self.indexes, index))

    def without_index(self, name: str) -> TableSpec:
        return TableSpec(self.name, self.columns, self.key, self.unique, self.references, tuple(i for i in self.indexes if i.name != name))


INTEGERS = {
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "int2": T.ShortType(), "mediumint": T.IntegerType(), "int": T.IntegerType(),
    "int4": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(), "int8": T.LongType(),
}
WIDER = {"byte": T.ShortType(), "short": T.IntegerType(), "integer": T.LongType(), "long": T.DecimalType(20, 0)}
FLOATS = {"float", "float4", "float8", "real", "double", "double precision"}
TEXTS = {"text", "tinytext", "mediumtext", "longtext", "clob", "citext", "string", "enum", "set", "uuid", "inet", "cidr", "macaddr", "time", "timetz"}
CHARS = {"varchar", "character varying", "nvarchar", "varchar2", "char", "bpchar", "character", "nchar"}
BINARIES = {"blob", "bytea", "binary", "varbinary", "tinyblob", "mediumblob", "longblob"}
DOCUMENT_CASTS = {"array", "json", "object", "collection"}


def map_type(column: ColumnSpec, owner: str = "") -> T.DataType | None:
    """The Spark type of a database type, the first rule that fits; None if none does. Casts come before types."""
    found = re.fullmatch(r"\s*([a-z][a-z0-9 ]*?)\s*(?:\((\d+)(?:\s*,\s*(\d+))?\))?\s*(unsigned)?\s*", column.type.lower())
    if not found:
        return None
    name, p, s = found[1], found[2] and int(found[2]), found[3] and int(found[3])
    unsigned, cast = column.unsigned or bool(found[4]), (column.cast or "").lower()
    if cast.startswith("encrypted"):
        return T.StringType()
    if cast in ("bool", "boolean") or name in ("bool", "boolean") or name == "tinyint" and p == 1:
        return T.BooleanType()
    if cast in DOCUMENT_CASTS or name in ("json", "jsonb"):
        return T.StringType()
    if name == "year":
        return T.ShortType()
    if name in INTEGERS:
        kind = T.LongType() if name == "integer" and owner == "sqlite" else INTEGERS[name]
        return WIDER[kind.typeName()] if unsigned else kind
    if name in ("decimal", "numeric", "number"):
        by_cast = re.fullmatch(r"decimal:(\d+)", cast)
        if not p:
            p, s = 38, int(by_cast[1]) if by_cast else 10
        p = min(p, 38)
        return T.DecimalType(p, min(s or 0, p))
    if name in FLOATS:
        return T.DoubleType()
    if name in TEXTS or name in CHARS:
        return T.StringType()
    if name == "date":
        return T.DateType()
    if name == "timestamptz" or name == "timestamp with time zone":
        return T.TimestampType()
    if name in ("timestamp", "datetime", "datetime2", "timestamp without time zone"):
        return T.TimestampNTZType()
    if name in BINARIES:
        return T.BinaryType()
    by_cast = {"int": T.LongType(), "integer": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampNTZType()}
    return by_cast.get(cast)


def infer_type(value) -> T.DataType:
    """The type of a computed column from one of its values."""
    import datetime
    import enum

    if isinstance(value, enum.Enum):
        value = value.value
    for kind, type_ in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (datetime.datetime, T.TimestampNTZType()), (datetime.date, T.DateType())):
        if isinstance(value, kind):
            return type_
    return T.StringType()


def plain_value(value):
    """A Python value as a table can hold it: enums by value, date-times without their offset, arrays and objects as JSON."""
    import datetime
    import enum
    import json

    if isinstance(value, enum.Enum):
        return plain_value(value.value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple, dict)):
        return json.dumps(value, ensure_ascii=False, default=str)
    return value


def with_casts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """df with the columns that spec has read as it has them: a mirror's columns by its owner's types and casts."""
    casts = {c.name: F.col(c.name).cast(kind) for c in spec.columns if c.name in df.columns and (kind := map_type(c)) is not None}
    return df.withColumns(casts) if casts else df


def with_defaults(df: DataFrame, spec: TableSpec) -> DataFrame:
    """df with the columns' defaults where it has nulls, and defaults for columns that it lacks."""
    out = df
    for c in spec.columns:
        if c.default is not None:
            default = F.lit(plain_value(c.default))
            out = out.withColumn(c.name, F.coalesce(F.col(c.name), default) if c.name in df.columns else default)
    return out


def kind_of(data_type: T.DataType) -> str:
    """bool, number, date, string or other."""
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "string" if isinstance(data_type, T.StringType) else "other"


@dataclass(frozen=True)
class SchemaPlan:
    """What it takes for a table to have the wanted columns; nothing is ever dropped or changed."""

    table: str
    create: bool
    added: tuple[T.StructField, ...]
    notes: tuple[str, ...]

    def sql(self) -> list[str]:
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString().upper()}" for f in self.added)
        if self.create:
            return [f"CREATE TABLE `{self.table}` ({listed}) USING parquet"]
        return [f"ALTER TABLE `{self.table}` ADD COLUMNS ({listed})"] if self.added else []

    def migration(self) -> tuple[list[str], list[str]]:
        """Statements to apply and to undo."""
        undo = [f"DROP TABLE `{self.table}`"] if self.create else [f"ALTER TABLE `{self.table}` DROP COLUMN `{f.name}`" for f in reversed(self.added)]
        return self.sql(), undo


    def apply(self, target) -> None:
        """Makes the table, or adds the columns, in a snapshot store or in a session's catalog."""
        if hasattr(target, "widen"):
            if self.create or self.added:
                key = next((f.name for f in self.added if not f.nullable), None) if self.create else None
                target.widen(self.table, list(self.added), key)
            return
        for statement in self.sql():
            target.sql(statement)


def plan_schema(table: str, wanted: T.StructType, key: str, existing: T.StructType | None = None) -> SchemaPlan:
    if key not in wanted.fieldNames():
        raise ValueError(f"{table} has no key {key}")
    fields = [T.StructField(f.name, f.dataType, f.name != key) for f in wanted]
    if existing is None:
        return SchemaPlan(table, True, tuple(fields), ())
    have = {f.name: f for f in existing}
    notes = [f"{f.name} is extra" for f in existing if f.name not in wanted.fieldNames()]
    notes += [f"{f.name} is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}" for f in fields if f.name in have and have[f.name].dataType != f.dataType]
    return SchemaPlan(table, False, tuple(f for f in fields if f.name not in have), tuple(notes))


SEARCHES = {"full_text", "trigram", "prefix", "like", "vector"}


def plan_search(spec: TableSpec, wanted: dict[str, tuple[str, ...]]) -> list[tuple[str, tuple[str, ...], str]]:
    """(search, columns, status) for each wanted search of a table; status: ok, missing, outdated or skipped.

    A `like` search takes a trigram index. An index on some of the columns only is outdated; columns that the table lacks
    are skipped.
    """
    out = []
    for search, columns in wanted.items():
        if search not in SEARCHES:
            raise ValueError(f"unknown search {search!r}")
        kind = "trigram" if search == "like" else search
        own = [set(i.columns) for i in spec.indexes if i.kind == kind]
        if any(spec.column(c) is None for c in columns):
            status = "skipped"
        elif set(columns) in own:
            status = "ok"
        elif any(o & set(columns) for o in own):
            status = "outdated"
        else:
            status = "missing"
        out.append((search, columns, status))
    return out


def foreign_key_order(tables: list[TableSpec]) -> list[TableSpec]:
    """Parents before their children; tables of a cycle keep the given order."""
    left, out = list(tables), []
    while left:
        names = {t.name for t in left}
        free = [t for t in left if not any(r in names and r != t.name for _, r in t.references)]
        if not free:
            return out + left
        out += free
        left = [t for t in left if t not in free]
    return out


def laid_out(df: DataFrame, spec: TableSpec) -> DataFrame:
    """df as it should be written so that its indexes' columns are found by row groups: sorted within partitions by the
    first plain, covering or descending index, with a column for each JSON key index (`meta->a` as `meta__a`)."""
    from ..functions.json import json_text

    out = df
    for index in spec.indexes:
        if index.kind == "json_key":
            out = out.withColumns({c.replace("->", "__"): json_text(c) for c in index.columns})
    for index in spec.indexes:
        if index.kind in ("plain", "covering", "desc"):
            ways = index.directions or ("desc" if index.kind == "desc" else "asc",) * len(index.columns)
            return out.sortWithinPartitions(*[F.desc(c) if w == "desc" else F.asc(c) for c, w in zip(index.columns, ways)])
    return out


def partial_rows(df: DataFrame, index: IndexSpec) -> DataFrame:
    """What a partial or covering index holds: its rows and columns."""
    rows = df.where(index.where) if index.where else df
    return rows.select(*dict.fromkeys([*index.columns, *index.include]))
