"""What a store may bring of its own instead of the operators here: past reads, search and similarity."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class HistoricalReads(Protocol):
    def as_of_time(self, time) -> HistoricalReads: ...
    def read_stale(self) -> HistoricalReads: ...
    def read_current(self) -> HistoricalReads: ...
    def get(self) -> DataFrame: ...


@runtime_checkable
class SearchBox(Protocol):
    def where_full_text(self, df: DataFrame, columns: list[str], text: str, mode: str, language: str | None) -> DataFrame: ...
    def with_relevance(self, df: DataFrame, columns: list[str], text: str, name: str, mode: str, language: str | None) -> DataFrame: ...


@runtime_checkable
class SimilaritySearch(Protocol):
    def similarity(self, column: str, value: str, unaccent: bool) -> Column: ...


_OWN: dict[type, object] = {}


def use(contract: type, own: object | None) -> None:
    """Takes `own` for the contract from now on; None takes the operators here again."""
    if own is None:
        _OWN.pop(contract, None)
    elif not isinstance(own, contract):
        raise TypeError(f"{type(own).__name__} lacks methods of {contract.__name__}")
    else:
        _OWN[contract] = own


def own(contract: type):
    return _OWN.get(contract)
