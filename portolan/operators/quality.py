"""Auditing data against a table's types, and comparing two copies of a table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import TableSpec, kind_of
from .relations import key_difference

# The ranges of the integer types, signed and unsigned.
RANGES = {
    "tinyint": (-128, 127, 255), "smallint": (-32768, 32767, 65535), "int2": (-32768, 32767, 65535), "mediumint": (-8388608, 8388607, 16777215),
    "int": (-2147483648, 2147483647, 4294967295), "integer": (-2147483648, 2147483647, 4294967295), "int4": (-2147483648, 2147483647, 4294967295),
}
BUCKETS = 20
LISTED = 10
PROBLEM = "table string, column string, problem string, detail string"


def audit_profile(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, list[tuple[str, str, Column]]]:
    """One row of all the checks' figures, and (column, problem, violated) for each check."""
    figures, checks = [], []
    for c in spec.columns:
        if c.name not in df.columns:
            continue
        kind = df.schema[c.name].dataType
        name, size = re.match(r"\s*([a-z ]+?\d?)\s*(?:\((\d+)\))?\s*(?:unsigned)?\s*$", c.type.lower()).groups()
        unsigned = c.unsigned or "unsigned" in c.type.lower()
        if isinstance(kind, T.NumericType) and (name in RANGES or name in ("bigint", "int8") and unsigned):
            least, most, most_unsigned = RANGES.get(name, (0, None, None))
            low, high = (0, most_unsigned) if unsigned else (least, most)
            figures += [F.min(c.name).alias(f"min_{c.name}"), F.max(c.name).alias(f"max_{c.name}")]
            bad = F.col(f"min_{c.name}") < low
            checks.append((c.name, "integer out of range", bad if high is None else bad | (F.col(f"max_{c.name}") > high)))
        elif isinstance(kind, T.StringType) and size and name in ("varchar", "char", "character varying", "character", "bpchar", "nvarchar", "nchar"):
            figures.append(F.max(F.char_length(c.name)).alias(f"length_{c.name}"))
            checks.append((c.name, "string too long", F.col(f"length_{c.name}") > int(size)))
    return df.agg(F.count("*").alias("rows"), *figures), checks


def audit_values(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Problems of the values: one aggregate over the table."""
    profile, checks = audit_profile(df, spec)
    spark = df.sparkSession
    if not checks:
        return spark.createDataFrame([], PROBLEM)
    detail = {"integer out of range": lambda c: F.concat_ws("..", F.col(f"min_{c}").cast("string"), F.col(f"max_{c}").cast("string")), "string too long": lambda c: F.col(f"length_{c}").cast("string")}
    rows = [F.when(bad, F.struct(F.lit(spec.name).alias("table"), F.lit(c).alias("column"), F.lit(p).alias("problem"), detail[p](c).alias("detail"))) for c, p, bad in checks]
    return profile.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("p")).select("p.*")


def audit(spark: SparkSession, source: dict[str, DataFrame], target: dict[str, TableSpec], tables: list[str] | None = None) -> DataFrame:
    """(table, column, problem, detail): what keeps the source's data from fitting the target; none if it fits."""
    found, frames = [], []
    for name in tables if tables is not None else sorted({*source, *target}):
        if name not in source:
            found.append((name, "*", "missing in source", ""))
        elif name not in target:
            found.append((name, "*", "missing in target", ""))
        else:
            found += [(name, c, "missing column", "") for c in source[name].columns if target[name].column(c) is None]
            frames.append(audit_values(source[name], target[name]))
    return reduce(DataFrame.unionByName, frames, spark.createDataFrame(found, PROBLEM))


def _figures(df: DataFrame, columns: list[str]) -> list[tuple[str, str, Column]]:
    """(column, measure, aggregate) by the kind of each column."""
    out = [("*", "rows", F.count("*"))]
    for c in columns:
        kind = kind_of(df.schema[c].dataType)
        out.append((c, "nulls", F.count(F.when(F.col(c).isNull(), 1))))
        if kind == "number":
            exact = F.col(c).cast("decimal(38,10)")
            out += [(c, "min", F.min(exact)), (c, "max", F.max(exact)), (c, "sum", F.sum(F.round(exact, 6).cast("decimal(28,6)")))]
        elif kind == "date":
            moment = F.col(c).cast("timestamp")
            out += [(c, "min", F.min(moment)), (c, "max", F.max(moment))]
        elif kind == "bool":
            out.append((c, "true", F.count(F.when(F.col(c), 1))))
        elif kind == "string":
            out.append((c, "length", F.sum(F.char_length(c))))
    return out


def compare_profile(owner: DataFrame, mirror: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, measure, owner, mirror, differs) over the shared columns: one aggregate a side, joined measure by measure."""
    shared = columns or [c for c in owner.columns if c in mirror.columns]

    def side(df: DataFrame, name: str) -> DataFrame:
        figures = _figures(owner, shared)
        one = df.agg(*[v.alias(f"f{i}") for i, (_, _, v) in enumerate(figures)])
        rows = [F.struct(F.lit(c).alias("column"), F.lit(m).alias("measure"), _plain(F.col(f"f{i}"), one.schema[f"f{i}"].dataType).alias(name)) for i, (c, m, _) in enumerate(figures)]
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    joined = side(owner, "owner").join(side(mirror, "mirror"), ["column", "measure"])
    return joined.withColumn("differs", ~F.col("owner").eqNullSafe(F.col("mirror")))


def _plain(value: Column, kind: T.DataType) -> Column:
    """Text without insignificant zeros; null stays null."""
    if isinstance(kind, T.DecimalType):
        text = value.cast("string")
        return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)
    return value.cast("string")


def lag_seconds(owner: DataFrame, mirror: DataFrame, version: str = "updated_at") -> int | None:
    """Seconds that the mirror's newest version is behind the owner's."""
    a, b = (df.agg(F.unix_timestamp(F.max(version).cast("timestamp"))).first()[0] for df in (owner, mirror))
    return None if a is None or b is None else a - b


def key_buckets(df: DataFrame, key: str, low: int, high: int, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of an integer key's values between low and high."""
    width = max(1, (high - low) // buckets + 1)
    return df.where(F.col(key).between(low, high)).groupBy(F.floor((F.col(key) - low) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def key_report(owner: DataFrame, mirror: DataFrame, key: str, listed: int = LISTED) -> DataFrame:
    """(side, n, keys): how many keys only one side has and the first of them as text; buckets of equal counts are compared too."""
    found = key_difference(owner, mirror, key)
    counted = found.groupBy("side").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    first = found.withColumn("r", F.row_number().over(Window.partitionBy("side").orderBy("key"))).where(F.col("r") <= listed)
    first = first.groupBy("side").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return counted.join(first, "side").select("side", "n", "keys")


def report(owner: DataFrame, mirror: DataFrame, key: str, compare: bool = True, keys: bool = True) -> tuple[DataFrame, bool]:
    """(label, owner, mirror, note) and whether the two differ."""
    spark = owner.sparkSession
    rows = [(c, "column", None, "missing in the mirror") for c in owner.columns if c not in mirror.columns]
    rows += [(c, None, "column", "extra") for c in mirror.columns if c not in owner.columns]
    out = spark.createDataFrame(rows, "label string, owner string, mirror string, note string")
    differs = False
    if compare:
        profile = compare_profile(owner, mirror)
        differs |= not profile.where("differs").isEmpty()
        out = out.unionByName(profile.select(F.concat_ws(".", "column", "measure").alias("label"), "owner", "mirror", F.when(F.col("differs"), "differs").otherwise("").alias("note")))
    if keys:
        found = key_report(owner, mirror, key)
        differs |= not found.isEmpty()
        note = F.concat_ws(", ", "keys")
        out = out.unionByName(found.select(F.lit("keys only here").alias("label"), F.when(F.col("side") == "a", F.col("n").cast("string")).alias("owner"), F.when(F.col("side") == "b", F.col("n").cast("string")).alias("mirror"), note.alias("note")))
    return out, differs


def table_statistics(spark: SparkSession, table: str) -> list[tuple[str, str, str]]:
    """(column, statistic, value) that ANALYZE TABLE has gathered of a catalog table; no scan of it."""
    out = []
    for c in spark.table(table).columns:
        rows = spark.sql(f"DESCRIBE EXTENDED `{table}` `{c}`").collect()
        out += [(c, r["info_name"], r["info_value"]) for r in rows if r["info_name"] in ("num_nulls", "distinct_count", "min", "max")]
    return out
