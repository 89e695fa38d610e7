"""Conditional aggregates, ROLLUP and JSON aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import json_number

FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def condition(df: DataFrame, given: Column | Callable[[DataFrame], Column]) -> Column:
    found = given if isinstance(given, Column) else given(df)
    if not isinstance(found, Column):
        raise ValueError("a condition has to say something")
    return found


def aggregate_where(function: str, column: str, given: Column, name: str) -> Column:
    """function over the column's values in rows for which the condition holds; * counts rows."""
    if function.lower() not in FUNCTIONS:
        raise ValueError(f"not one of {', '.join(FUNCTIONS)}: {function!r}")
    if column == "*" and function.lower() != "count":
        raise ValueError("only count takes *")
    value = F.lit(1) if column == "*" else F.col(column)
    return FUNCTIONS[function.lower()](F.when(given, value)).alias(name)


def count_where(name: str, given: Column) -> Column:
    return aggregate_where("count", "*", given, name)


def sum_where(name: str, column: str, given: Column) -> Column:
    """Null when nothing matches."""
    return aggregate_where("sum", column, given, name)


def rollup(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Groups, subtotals of each prefix of the keys and the grand total, which is there for an empty input too.

    Whether the input is empty takes a row of each partition, not another aggregation.
    """
    if not keys or not all(isinstance(k, str) for k in keys):
        raise ValueError("rollup needs the names of its columns")
    totals = df.rollup(*keys).agg(*aggregates)
    nulls = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
    some = df.select(F.lit(1).alias("__one")).limit(1)
    alone = df.limit(0).agg(*aggregates).withColumn("__one", F.lit(1)).join(some, "__one", "left_anti").drop("__one")
    return totals.unionByName(alone.select(*nulls, *alone.columns))


def union_rollup(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """The same by one grouping a level, for comparison."""
    if not keys:
        raise ValueError("rollup needs the names of its columns")
    out = None
    for n in range(len(keys), -1, -1):
        level = df.groupBy(*keys[:n]).agg(*aggregates) if n else df.agg(*aggregates)
        level = level.withColumns({k: F.lit(None).cast(df.schema[k].dataType) for k in keys[n:]})
        out = level if out is None else out.unionByName(level)
    return out


def sum_json(path: str) -> Column:
    """0 over no rows."""
    return F.coalesce(F.sum(json_number(path)), F.lit(0.0))


def avg_json(path: str) -> Column:
    return F.avg(json_number(path))


def min_json(path: str) -> Column:
    return F.min(json_number(path))


def max_json(path: str) -> Column:
    return F.max(json_number(path))


def time_window(df: DataFrame, column: str, width: str, *aggregates: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling windows with their bounds as _wstart and _wend."""
    out = df.groupBy(F.window(column, width).alias("__w"), *keys).agg(*aggregates)
    return out.select(F.col("__w.start").alias("_wstart"), F.col("__w.end").alias("_wend"), *[c for c in out.columns if c != "__w"])


def sample_by_hash(df: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key's MD5 begins below the share of its first byte's 256 values: the same rows wherever it is asked."""
    return df.where(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 2) < f"{round(share * 256):02x}")
