"""Predicates on JSON numbers and text."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts
from ..functions.json import json_number, json_text
from ..functions.text import THRESHOLD, escape_like, literal, operand, similarity

COMPARE = {"=": operator.eq, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "<>": operator.ne, "!=": operator.ne}


def json_number_is(path: str, op: str, number: int | float) -> Column:
    if op not in COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    return COMPARE[op](json_number(path), F.lit(float(number)))


def where_json_number(df: DataFrame, path: str, op: str, number: int | float) -> DataFrame:
    return df.where(json_number_is(path, op, number))


def either(*predicates: Column) -> Column:
    """The predicates joined by OR."""
    out = predicates[0]
    for p in predicates[1:]:
        out = out | p
    return out


def starts_with(column: str, value: str, unaccent: bool = False) -> Column:
    return operand(F.col(column), unaccent).startswith(literal(value, unaccent))


def contains(column: str, value: str, unaccent: bool = False) -> Column:
    return operand(F.col(column), unaccent).contains(literal(value, unaccent))


def like(column: str, pattern: str, unaccent: bool = False) -> Column:
    """Case-insensitive LIKE; a backslash escapes."""
    return operand(F.col(column), unaccent).like(literal(pattern, unaccent))


def not_like(column: str, pattern: str, unaccent: bool = False) -> Column:
    return ~like(column, pattern, unaccent)


def like_literal(column: str, before: str, value: str, after: str, unaccent: bool = False) -> Column:
    """LIKE with a value whose own % and _ are literal."""
    return like(column, before + escape_like(value) + after, unaccent)


def similar(column: str, value: str, threshold: float | None = None, unaccent: bool = False) -> Column:
    """Trigram similarity of 0.3 at least, and of the threshold if there is one."""
    box = contracts.own(contracts.SimilaritySearch)
    score = box.similarity(column, value, unaccent) if box else similarity(F.col(column), value, unaccent)
    return score >= max(THRESHOLD, threshold or 0.0)


def with_similarity(df: DataFrame, column: str, value: str, name: str = "similarity", unaccent: bool = False) -> DataFrame:
    return df.withColumn(name, similarity(F.col(column), value, unaccent))


def json_contains(path: str, value) -> Column:
    """Whether the JSON array at the path holds the value."""
    import json

    items = F.from_json(json_text(path), "array<string>")
    return F.coalesce(F.array_contains(items, value if isinstance(value, str) else json.dumps(value)), F.lit(False))


def json_contains_key(path: str) -> Column:
    return json_text(path).isNotNull()


def json_length(path: str) -> Column:
    return F.json_array_length(json_text(path))


def date_is(column: str, day: str) -> Column:
    return F.to_date(F.col(column)) == F.lit(day).cast("date")


def year_is(column: str, year: int) -> Column:
    return F.year(F.col(column)) == year


def month_is(column: str, month: int) -> Column:
    return F.month(F.col(column)) == month


def day_is(column: str, day: int) -> Column:
    return F.dayofmonth(F.col(column)) == day


def time_is(column: str, op: str, time: str) -> Column:
    """Compares the time of day; time is HH:MM or HH:MM:SS."""
    if op not in COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    whole = time if time.count(":") == 2 else f"{time}:00"
    return COMPARE[op](F.date_format(F.col(column).cast("timestamp"), "HH:mm:ss"), F.lit(whole))


def with_deleted(df: DataFrame) -> DataFrame:
    """All rows: what a table that marks its deleted rows shows unless it is told to hide them."""
    return df


def only_deleted(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def not_deleted(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNull())
