"""Relations between tables as joins."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import COMPARE


def where_has(parents: DataFrame, children: DataFrame, key: str, foreign: str, given: Column | None = None) -> DataFrame:
    """Parents with a child for which the condition holds."""
    found = (children if given is None else children.where(given)).select(F.col(foreign).alias("__fk"))
    return parents.join(found, parents[key] == F.col("__fk"), "left_semi")


def has(parents: DataFrame, children: DataFrame, key: str, foreign: str, op: str = ">=", n: int = 1) -> DataFrame:
    """Parents with so many children; parents without any have 0."""
    if op not in COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    counted = with_count(parents, children, key, foreign, "__n")
    return counted.where(COMPARE[op](F.col("__n"), n)).drop("__n")


def with_aggregate(parents: DataFrame, children: DataFrame, key: str, foreign: str, aggregate: Column, name: str) -> DataFrame:
    found = children.groupBy(F.col(foreign).alias("__fk")).agg(aggregate.alias(name))
    return parents.join(found, parents[key] == F.col("__fk"), "left").drop("__fk")


def with_count(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str = "count") -> DataFrame:
    out = with_aggregate(parents, children, key, foreign, F.count("*"), name)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))


def with_many(parents: DataFrame, children: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """Each parent's children as an array of structs, sorted, empty where it has none. Meant for bounded numbers of children."""
    found = children.groupBy(F.col(foreign).alias("__fk")).agg(F.sort_array(F.collect_list(F.struct(*children.columns))).alias(name))
    out = parents.join(found, parents[key] == F.col("__fk"), "left").drop("__fk")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(found.schema[name].dataType)))


def with_one(rows: DataFrame, others: DataFrame, foreign: str, key: str, name: str) -> DataFrame:
    """Each row's counterpart as a struct; null where there is none."""
    found = others.select(F.col(key).alias("__k"), F.struct(*others.columns).alias(name))
    return rows.join(found, rows[foreign] == F.col("__k"), "left").drop("__k")


def with_morph(rows: DataFrame, kinds: dict[str, tuple[DataFrame, str]], kind: str, foreign: str, value: str, name: str) -> DataFrame:
    """The column `value` of the table that each row's kind names; kinds: (table, key) by kind."""
    out, made = rows, []
    for i, (label, (table, key)) in enumerate(kinds.items()):
        found = table.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.join(found, (F.col(kind) == label) & (F.col(foreign) == F.col(f"__k{i}")), "left")
        made.append(F.col(f"__v{i}"))
    return out.select(*rows.columns, F.coalesce(*made).alias(name))


def keys_gone(keys: DataFrame, owner: DataFrame, key: str) -> DataFrame:
    """Keys that the owner no longer has."""
    return keys.select(key).distinct().join(owner.select(key), key, "left_anti")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys, compared as text, that only one of the tables has; side is a or b. One aggregate over both."""
    of = lambda x, side: x.select(F.col(key).cast("string").alias("key"), F.lit(side).alias("side"))
    found = of(a, 1).unionAll(of(b, 2)).groupBy("key").agg(F.bit_or("side").alias("side")).where("side < 3")
    return found.withColumn("side", F.when(F.col("side") == 1, "a").otherwise("b"))
