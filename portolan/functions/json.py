"""Values of JSON text columns by path, `column->key->nested`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_path(path: str) -> tuple[str, list[str]]:
    """(column, keys) of a path; a path needs a column and a key at least."""
    column, *keys = path.split("->")
    if not column.strip() or not keys or not all(k.strip() for k in keys):
        raise ValueError(f"not a JSON path such as column->key: {path!r}")
    return column.strip(), [k.strip() for k in keys]


def _at(document: Column, key: str) -> Column:
    if "'" in key or "\\" in key:  # quoted paths can't hold these
        return F.from_json(document, "map<string,string>")[key]
    return F.get_json_object(document, f"$['{key}']")


def json_text(path: str, column: Callable[[str], Column] = F.col) -> Column:
    """The value as text; null if it is missing or JSON null. column: what makes the path's column of its name."""
    name, keys = split_path(path)
    if any("'" in k or "\\" in k for k in keys):
        value = column(name)
        for key in keys:
            value = _at(value, key)
        return value
    return F.get_json_object(column(name), "$" + "".join(f"['{k}']" for k in keys))


def json_number(path: str, column: Callable[[str], Column] = F.col) -> Column:
    """The value as a double, numeric strings included; null if it isn't a number."""
    return json_text(path, column).try_cast("double")


def json_bool(path: str, column: Callable[[str], Column] = F.col) -> Column:
    text = json_text(path, column)
    return F.when(text == "true", True).when(text == "false", False)


def cast_text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def char_length(column: Column | str) -> Column:
    return F.char_length(column)


class On:
    """The expressions bound to a source: a DataFrame, the alias of one, or a struct column."""

    def __init__(self, source: DataFrame | str | Column):
        self.source = source

    def column(self, name: str) -> Column:
        return F.col(f"{self.source}.{name}") if isinstance(self.source, str) else self.source[name]

    def json_text(self, path: str) -> Column:
        return json_text(path, self.column)

    def json_number(self, path: str) -> Column:
        return json_number(path, self.column)

    def json_bool(self, path: str) -> Column:
        return json_bool(path, self.column)

    def cast_text(self, name: str) -> Column:
        return cast_text(self.column(name))

    def char_length(self, name: str) -> Column:
        return char_length(self.column(name))


def on(source: DataFrame | str | Column) -> On:
    return On(source)


def _plus(document: Column, keys: list[str], amount: int | float) -> Column:
    """The document with keys' value raised; what isn't an object starts as an empty one."""
    empty = F.create_map().cast("map<string,variant>")
    fields = F.coalesce(F.from_json(document, "map<string,variant>"), empty)
    others = F.map_filter(fields, lambda k, _: k != keys[0])
    old = F.try_element_at(fields, F.lit(keys[0]))
    if len(keys) > 1:
        new = F.parse_json(_plus(F.to_json(old), keys[1:], amount))
    else:
        text = F.try_variant_get(old, "$", "string")
        whole = F.coalesce(text.try_cast("bigint"), F.when(text.try_cast("double").isNull(), F.lit(0)))
        if isinstance(amount, int):
            new = F.when(whole.isNotNull(), (whole + amount).cast("variant")).otherwise((text.try_cast("double") + amount).cast("variant"))
        else:
            new = (F.coalesce(text.try_cast("double"), F.lit(0.0)) + amount).cast("variant")
    return F.to_json(F.map_concat(others, F.create_map(F.lit(keys[0]), new)))


def increment_json(path: str, amount: int | float = 1) -> Column:
    """The path's column as JSON text with the value raised by amount, a missing value counting as 0."""
    column, keys = split_path(path)
    return _plus(F.col(column), keys, amount)


def decrement_json(path: str, amount: int | float = 1) -> Column:
    return increment_json(path, -amount)


def with_incremented(df: DataFrame, path: str, amount: int | float = 1, extra: dict | None = None, where: Column | None = None, touch: str | None = "updated_at") -> DataFrame:
    """df with the path's value raised by amount in the rows that `where` holds for, the extra columns set there, and the
    touched column set to now, if there is one."""
    column, _ = split_path(path)
    new = {column: increment_json(path, amount)}
    if touch and touch in df.columns:
        new[touch] = F.current_timestamp().cast(df.schema[touch].dataType)
    for name, value in (extra or {}).items():
        new[name] = (value if isinstance(value, Column) else F.lit(value)).cast(df.schema[name].dataType)
    if where is not None:
        hit = F.coalesce(where, F.lit(False))
        new = {name: F.when(hit, value).otherwise(F.col(name)) for name, value in new.items()}
    return df.withColumns(new)
