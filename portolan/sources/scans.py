"""Scans and sinks that copying uses, and copying itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import TableSpec, foreign_key_order
from .store import SnapshotStore


def catalog(spark: SparkSession) -> DataFrame:
    """(table, column, type) of the session's tables and views."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def catalog_keys(spark: SparkSession, specs: list[TableSpec]) -> DataFrame:
    """(table, kind, name, columns, refers_to) of the specifications' keys, unique keys, indexes and foreign keys."""
    rows = []
    for s in specs:
        rows += [(s.name, "key", "key", list(s.key), None)] if s.key else []
        rows += [(s.name, "unique", "_".join(u), list(u), None) for u in s.unique]
        rows += [(s.name, f"{i.kind} index", i.name, list(i.columns), None) for i in s.indexes]
        rows += [(s.name, "foreign key", c, [c], t) for c, t in s.references]
    return spark.createDataFrame(rows, "table string, kind string, name string, columns array<string>, refers_to string")


def next_keys(store: SnapshotStore, specs: list[TableSpec]) -> dict[str, int]:
    """After copying: the first free value of each table's integer key, for whoever numbers its rows."""
    out = {}
    for s in specs:
        if len(s.key) == 1 and store.exists(s.name):
            rows = store.read(s.name)
            if isinstance(rows.schema[s.key[0]].dataType, T.IntegralType):
                out[s.name] = (rows.agg(F.max(s.key[0])).first()[0] or 0) + 1
    return out


def most_recent(df: DataFrame, key: str | None, n: int) -> DataFrame:
    """The n rows with the largest keys; without a key, any n."""
    return df.orderBy(F.desc(key)).limit(n) if key else df.limit(n)


def after_high_water(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Source rows beyond the target's largest key; integer keys only."""
    if not isinstance(source.schema[key].dataType, T.IntegralType):
        raise ValueError(f"resuming takes an integer key, {key} isn't one")
    high = target.agg(F.max(key)).first()[0]
    return source if high is None else source.where(F.col(key) > high)


def changed_since(df: DataFrame, since, column: str = "updated_at") -> DataFrame:
    if column not in df.columns:
        raise ValueError(f"there is no column {column} to tell changes by")
    return df.where(F.col(column) >= F.lit(since).cast("timestamp"))


def dry_run_count(df: DataFrame, sample: int | None = None) -> int:
    n = df.count()
    return n if sample is None else min(n, sample)


def shared_columns(source: DataFrame, target: DataFrame) -> list[str]:
    return [c for c in source.columns if c in target.columns]


def conform(source: DataFrame, target: T.StructType) -> DataFrame:
    """The shared columns as the target has them; documents become JSON text."""
    out = []
    for f in target:
        if f.name not in source.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        kind, c = source.schema[f.name].dataType, F.col(f.name)
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) and isinstance(f.dataType, T.StringType):
            c = F.to_json(c)
        elif isinstance(kind, T.StringType) and isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp").cast("timestamp_ntz")  # offsets become UTC
        out.append(c.cast(f.dataType).alias(f.name))
    return source.select(*out)


def insert_or_ignore(target: DataFrame, rows: DataFrame, unique: list[list[str]]) -> DataFrame:
    """The rows that can be added: one of each unique key, none that the target has. Null keys never clash."""
    out = rows
    for keys in unique:
        whole = " and ".join(f"`{k}` is not null" for k in keys)
        out = out.where(whole).dropDuplicates(keys).unionByName(out.where(f"not ({whole})"))
        out = out.join(target.select(*keys), keys, "left_anti").select(*rows.columns)
    return out


@dataclass
class CopyResult:
    table: str
    rows: int
    status: str


def copy(source: SnapshotStore, target: SnapshotStore, specs: list[TableSpec], except_: tuple[str, ...] = ("migrations",), sample: int | None = None,
         resume: bool = False, dry_run: bool = False, progress=None) -> list[CopyResult]:
    """Copies the tables, parents first; a failing table doesn't stop the others."""
    out = []
    for spec in foreign_key_order([s for s in specs if s.name not in except_]):
        if not (source.exists(spec.name) and target.exists(spec.name)):
            out.append(CopyResult(spec.name, 0, "missing on one side"))
            continue
        try:
            out.append(_copy_one(source, target, spec, sample, resume, dry_run))
        except Exception as e:  # the report says so, and the next table is copied
            out.append(CopyResult(spec.name, 0, f"failed after 0 row(s): {e}"[:300]))
        if progress:
            progress(out[-1])
    return out


def _copy_one(source: SnapshotStore, target: SnapshotStore, spec: TableSpec, sample, resume: bool, dry_run: bool) -> CopyResult:
    key = spec.key[0] if spec.key else None
    rows, have = source.read(spec.name), target.read(spec.name)
    if dry_run:
        return CopyResult(spec.name, dry_run_count(rows, sample), "would copy")
    if sample is not None:
        rows = most_recent(rows, key, sample)
    elif resume and key and len(spec.key) == 1 and isinstance(rows.schema[key].dataType, T.IntegralType):
        rows = after_high_water(rows, have, key)
    wanted = rows.count()
    unique = [list(spec.key)] * bool(spec.key) + [list(u) for u in spec.unique]
    added = insert_or_ignore(have, conform(rows, have.schema), unique)
    before, parent = have.count(), target.at(spec.name).id
    if target.at(spec.name).key:
        target.commit(spec.name, have.unionByName(added), "copy", parent=parent)
    else:
        target.append(spec.name, added.select(*have.columns), "copy", parent=parent)
    after = target.read(spec.name).count()
    n = after - before
    skipped = f", {wanted - n} skipped" if wanted > n else ""
    whole = source.read(spec.name).count()
    if sample is None and after < whole:
        return CopyResult(spec.name, n, f"incomplete: the target has {after} of {whole} row(s){skipped}")
    return CopyResult(spec.name, n, "copied" + skipped)
