"""Full-text indexes as tables: made from a table of a store, chosen by the columns asked for, rebuilt and dropped."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from ..functions.fulltext import keys_with_every, token_table
from ..functions.text import tokens_of
from .store import SnapshotStore

_MARK = "__fulltext_"


@dataclass(frozen=True)
class Definition:
    """An index of a table's columns by its key."""

    name: str
    table: str
    key: str
    columns: tuple[str, ...]
    language: str | None = None


class FullTextIndexes:
    def __init__(self, store: SnapshotStore):
        self.store = store

    def create(self, table: str, key: str, columns: list[str], language: str | None = None) -> Definition:
        missing = [c for c in [key, *columns] if c not in self.store.read(table).columns]
        if missing or not columns:
            raise ValueError(f"{table} has no columns {', '.join(missing) or '(none asked for)'}")
        made = Definition(f"{table}{_MARK}{uuid.uuid4().hex[:8]}", table, key, tuple(columns), language)
        self._write(made)
        return made

    def _write(self, index: Definition) -> None:
        rows = token_table(self.store.read(index.table), index.key, list(index.columns), index.language)
        op = "full_text " + json.dumps(asdict(index))
        self.store.commit(index.name, rows.repartitionByRange("token").sortWithinPartitions("token", "key"), op)

    def definition(self, name: str) -> Definition:
        given = json.loads(self.store.at(name).op.removeprefix("full_text "))
        return Definition(**{**given, "columns": tuple(given["columns"])})

    def of(self, table: str) -> list[Definition]:
        return [self.definition(t) for t in self.store.tables() if t.startswith(table + _MARK)]

    def index_for(self, table: str, columns: list[str], language: str | None = None) -> Definition:
        """The index of all these columns that has the fewest others."""
        able = [i for i in self.of(table) if {*columns} <= {*i.columns} and i.language == language]
        if not able:
            raise LookupError(f"{table} has no full-text index of {', '.join(columns)}")
        return min(able, key=lambda i: (len(i.columns), i.name))

    def rebuild(self, name: str) -> None:
        self._write(self.definition(name))

    def drop(self, table: str, columns: list[str] | None = None) -> list[str]:
        """Drops the table's indexes, or those of just these columns, with their rows; the names of those dropped."""
        gone = [i.name for i in self.of(table) if columns is None or {*columns} == {*i.columns}]
        for name in gone:
            self.store.drop(name)
        return gone

    def drop_table(self, table: str) -> None:
        """Drops the table and its indexes."""
        self.drop(table)
        self.store.drop(table)

    def keys(self, table: str, columns: list[str], text: str, language: str | None = None) -> DataFrame:
        """Keys of the rows that hold all words of the text in the columns: read from the stored index, whose files are
        sorted by token, so that only row groups with these tokens are read."""
        index = self.index_for(table, columns, language)
        rows = self.store.read(index.name)
        if {*columns} != {*index.columns}:
            rows = rows.where(rows["column"].isin(columns))
        return keys_with_every(rows, tokens_of(text, language))
