"""Orderings with explicit places for nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import json_number
from ..functions.text import literal, operand, similarity


def direction_of(direction: str) -> str:
    if str(direction).lower() not in ("asc", "desc"):
        raise ValueError(f"a direction is asc or desc, not {direction!r}")
    return direction.lower()


def nulls_last(column: Column | str, direction: str = "asc") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.desc_nulls_last() if direction_of(direction) == "desc" else column.asc_nulls_last()


def json_number_order(path: str, direction: str = "asc", last: bool = False) -> Column:
    """Numeric order of a JSON value. Without last, nulls are first upwards and last downwards, and whatever isn't desc is asc."""
    number = json_number(path)
    if last:
        return nulls_last(number, direction)
    return number.desc_nulls_last() if str(direction).lower() == "desc" else number.asc_nulls_first()


def order_by_json_number(df: DataFrame, path: str, direction: str = "asc", last: bool = False, *then: Column) -> DataFrame:
    return df.orderBy(json_number_order(path, direction, last), *then)


def order_by_nulls_last(df: DataFrame, column: Column | str, direction: str = "asc", *then: Column) -> DataFrame:
    return df.orderBy(nulls_last(column, direction), *then)


def order_by_similarity(df: DataFrame, column: str, value: str, direction: str = "desc", unaccent: bool = False, *then: Column) -> DataFrame:
    score = similarity(F.col(column), value, unaccent)
    return df.orderBy(score.desc() if direction_of(direction) == "desc" else score.asc(), *then)


def suggest(df: DataFrame, column: str, value: str, unaccent: bool = False) -> DataFrame:
    """Autocomplete: for under three characters prefixes only, the shortest first; else substrings and similar values too,
    prefixes first, then by similarity, length and value. A blank value suggests nothing."""
    value = value.strip()
    if not value:
        return df.where(F.lit(False))
    text, low = operand(F.col(column), unaccent), literal(value, unaccent)
    size = [F.char_length(column).asc(), F.col(column).asc()]
    if len(value) < 3:
        return df.where(text.startswith(low)).orderBy(*size)
    score = similarity(F.col(column), value, unaccent)
    hit = text.contains(low) | (score >= 0.3)
    return df.where(hit).orderBy(F.when(text.startswith(low), 0).otherwise(1), score.desc(), *size)


def distinct_on(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    from pyspark.sql import Window

    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")
