"""Mirrors: derived copies of owner tables that are kept up by key, guarded by a version."""

from __future__ import annotations

import pkgutil
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, replace
from importlib import import_module

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import SchemaPlan, plan_schema
from ..sources.store import SnapshotStore


class MirrorIsReadOnly(RuntimeError):
    """Mirrors are written by their owner's changes only."""


@dataclass(frozen=True)
class MirrorSpec:
    """A mirror of an owner table. keep: rows for which it isn't true are removed; transform: owner rows to mirror rows.

    Hooks: owner_query, what of the owner is read at all; columns, the mirror's schema where it isn't that of the shaped
    rows; alias, the owner's name in changes and reports.
    """

    owner: str
    mirror: str
    key: str = "id"
    owner_key: str | None = None
    version: str | None = "updated_at"
    keep: Column | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    versions: str = "latest"
    valid_time: str = "updated_at"
    erase_on_force_delete: bool = False
    owner_query: Callable[[DataFrame], DataFrame] | None = None
    columns: T.StructType | None = None
    alias: str | None = None

    def __post_init__(self):
        if self.versions not in ("latest", "all"):
            raise ValueError("versions are latest or all")
        if self.owner == self.mirror:
            raise ValueError("a mirror can't write its owner's own table")

    def shaped(self, rows: DataFrame) -> DataFrame:
        out = self.transform(rows) if self.transform else rows
        if self.owner_key and self.owner_key != self.key and self.owner_key in out.columns:
            out = out.withColumnRenamed(self.owner_key, self.key)
        if self.columns is not None:
            given = [F.col(f.name) if f.name in out.columns else F.lit(None) for f in self.columns]
            out = out.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(given, self.columns)])
        return out

    def read_owner(self, rows: DataFrame) -> DataFrame:
        return self.owner_query(rows) if self.owner_query else rows

    @property
    def name(self) -> str:
        return self.alias or self.owner

    def schema_plan(self, owner: DataFrame, existing=None) -> SchemaPlan:
        return plan_schema(self.mirror, self.shaped(owner).schema, self.key, existing)


@dataclass
class Registry:
    """Mirrors by owner, and switches: None is unconfigured, which counts as on. defaults: settings of mirrors that don't
    say otherwise; history_store: where mirrors that keep all versions write them."""

    specs: dict[str, list[MirrorSpec]] = field(default_factory=dict)
    switches: dict[str, bool | None] = field(default_factory=dict)
    paused: set[str] = field(default_factory=set)
    defaults: dict[str, object] = field(default_factory=dict)
    history_store: SnapshotStore | None = None

    def register(self, spec: MirrorSpec) -> MirrorSpec:
        plain = {f.name: f.default for f in fields(MirrorSpec)}
        unknown = [k for k in self.defaults if k not in plain]
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        spec = replace(spec, **{k: v for k, v in self.defaults.items() if getattr(spec, k) is plain[k] or getattr(spec, k) == plain[k]})
        every = [s for specs in self.specs.values() for s in specs]
        if any(s.mirror == spec.mirror for s in every):
            raise ValueError(f"{spec.mirror} is a mirror already")
        if spec.versions == "all" and self.history_store is None:
            raise ValueError(f"{spec.mirror} keeps all versions, and there is no history store")
        self.specs.setdefault(spec.owner, []).append(spec)
        return spec

    def discover(self, package: str) -> list[MirrorSpec]:
        """Registers the MirrorSpecs that the modules of a package define, by module and name."""
        root = import_module(package)
        names = [package] + [m.name for m in pkgutil.walk_packages(getattr(root, "__path__", []), package + ".")]
        found: dict[int, MirrorSpec] = {}  # a spec that several names hold is one
        for module in map(import_module, sorted(names)):
            found |= {id(v): v for _, v in sorted(vars(module).items()) if isinstance(v, MirrorSpec)}
        return [self.register(s) for s in found.values()]

    def of(self, owner: str) -> list[MirrorSpec]:
        return self.specs.get(owner, [])

    def owner_of(self, mirror: str) -> str:
        found = [o for o, specs in self.specs.items() for s in specs if s.mirror == mirror]
        if not found:
            raise LookupError(f"{mirror} is no mirror")
        return found[0]

    def switch(self, name: str, on: bool | None) -> None:
        self.switches[name] = on

    def active(self, spec: MirrorSpec) -> bool:
        names = ("*", spec.owner, spec.mirror)
        return spec.owner not in self.paused and all(self.switches.get(n) is not False for n in names)

    @contextmanager
    def without_mirroring(self, owner: str):
        added = owner not in self.paused
        self.paused.add(owner)
        try:
            yield
        finally:
            if added:
                self.paused.discard(owner)


def latest(rows: DataFrame, key: str, version: str | None = None, sequence: str | None = None) -> DataFrame:
    """The row of the newest version of each key; of equal versions, the one of the largest sequence number. A null version counts
    as the newest, since it always applies."""
    from pyspark.sql import Window

    order = [F.col(c).desc_nulls_first() for c in (version, sequence) if c and c in rows.columns]
    if not order:
        return rows.dropDuplicates([key])
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def merge(current: DataFrame, incoming: DataFrame, key: str, version: str | None = None, sequence: str | None = None) -> DataFrame:
    """current with incoming written over it, key by key.

    A row applies unless the current version is newer; null versions and equal ones apply. Columns that incoming lacks stay
    as they are, whereas nulls in it are written. Columns that current lacks are ignored, but for version and sequence.
    """
    if key not in incoming.columns:
        raise ValueError(f"the rows have no key {key}")
    written = [c for c in current.columns if c in incoming.columns and c != key]
    rows = latest(incoming, key, version, sequence)
    rows = rows.withColumn("__key", F.coalesce(F.col(key), F.raise_error(F.lit(f"a row's key {key} is null")).cast(rows.schema[key].dataType)))
    if version is None or version not in incoming.columns or version not in current.columns:
        guard = F.lit(bool(written))
    else:
        guard = F.col("i.__new")[version].isNull() | F.col(f"c.{version}").isNull() | (F.col(f"c.{version}") <= F.col("i.__new")[version])
    new = rows.select("__key", F.struct(*[F.col(c) for c in [key, *written]]).alias("__new"))
    joined = current.alias("c").join(new.alias("i"), F.col(f"c.{key}") == F.col("i.__key"), "full_outer")
    fresh = F.col(f"c.{key}").isNull()
    out = []
    for c in current.columns:
        kind = current.schema[c].dataType
        if c == key:
            out.append(F.coalesce(F.col(f"c.{key}"), F.col("i.__key")).cast(kind).alias(c))
        elif c in written:
            taken = F.col("i.__key").isNotNull() & (fresh | guard)
            out.append(F.when(taken, F.col("i.__new")[c].cast(kind)).otherwise(F.col(f"c.{c}")).alias(c))
        else:
            out.append(F.col(f"c.{c}").alias(c))
    return joined.select(*out)


def remove(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti").select(*current.columns)


@dataclass
class Mirror:
    """A mirror in a store, and its owner's rows as a function, so that the newest are read at each call."""

    spec: MirrorSpec
    store: SnapshotStore
    owner: Callable[[], DataFrame]
    registry: Registry | None = None

    def _on(self) -> bool:
        return self.registry is None or self.registry.active(self.spec)

    def _owned(self) -> DataFrame:
        return self.spec.read_owner(self.owner())

    def _owner_key(self) -> str:
        return self.spec.owner_key or self.spec.key

    def create(self) -> None:
        self.store.commit(self.spec.mirror, self.spec.shaped(self._owned()).limit(0), "create", key=self.spec.key)

    def read(self) -> DataFrame:
        return self.store.read(self.spec.mirror)

    def write(self, *_, **__):
        raise MirrorIsReadOnly(f"{self.spec.mirror} is a mirror of {self.spec.owner}")

    insert = update = delete = upsert = write

    def _split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows to write, and keys to remove because keep isn't true of them."""
        if self.spec.keep is None:
            return rows, rows.limit(0).select(F.col(self._owner_key()).alias(self.spec.key))
        kept = F.coalesce(self.spec.keep, F.lit(False))
        return rows.where(kept), rows.where(~kept).select(F.col(self._owner_key()).alias(self.spec.key))

    def _version(self) -> str | None:
        return self.spec.version

    def apply(self, actions: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Brings the mirror up to the owner's rows of the keys in (key, action), one row a key: of those to sync, rows that
        are there are written and the others removed; remove and erase remove without asking. Only the buckets of the keys
        are read and written."""
        if not self._on():
            return
        key, owner_key = self.spec.key, self._owner_key()
        actions = actions.select(F.col(actions.columns[0]).alias(key), F.col("action"))
        asked = actions.where(F.col("action") == "sync").select(key)
        rows = self._owned().join(asked.withColumnRenamed(key, "__k"), F.col(owner_key) == F.col("__k"), "left_semi")
        kept, unkept = self._split(rows)
        there = rows.select(F.col(owner_key).alias(key))
        gone = actions.where(F.col("action") != "sync").select(key).unionByName(asked.join(there, key, "left_anti")).unionByName(unkept)
        shaped = self.spec.shaped(kept)
        self.store.change(self.spec.mirror, actions.select(key), lambda now: remove(merge(now, shaped, key, self._version()), gone, key), "apply", batch)

    def sync(self, keys: DataFrame, action: str = "sync", batch: tuple[str, int] | None = None) -> None:
        """The same action for all keys."""
        if action not in ACTIONS:
            raise ValueError(f"unknown action {action!r}")
        self.apply(keys.select(F.col(keys.columns[0]).alias("key"), F.lit(action).alias("action")).distinct(), batch)

    def upsert_rows(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        key = self.spec.key
        self.store.change(self.spec.mirror, rows.select(key), lambda now: merge(now, rows, key, self._version()), "upsert", batch)

    def backfill(self, since=None, progress: Callable[[int, int], None] | None = None) -> tuple[int, int]:
        """Writes all of the owner's rows, or those changed since; (rows written, keys removed). The rows are counted as
        they are written; progress gets both numbers at the end."""
        from ..sources.scans import changed_since

        key = self.spec.key
        rows = self._owned() if since is None else changed_since(self._owned(), since)
        kept, unkept = self._split(rows)
        written, removed = Observation(), Observation()
        shaped = self.spec.shaped(kept.observe(written, F.count("*").alias("n")))

        def make(now: DataFrame) -> DataFrame:
            out = unkept.join(now.select(key), key, "left_semi").distinct().observe(removed, F.count("*").alias("n"))
            return remove(merge(now, shaped, key, self._version()), out, key)

        now = self.store.at(self.spec.mirror)
        self.store.commit(self.spec.mirror, make(self.read()), "backfill", parent=now.id)
        told = (_seen(written), _seen(removed) if self.spec.keep is not None else 0)
        if progress:
            progress(*told)
        return told

    def prune(self) -> None:
        """Removes rows whose owner row is gone."""
        from .relations import keys_gone

        key = self.spec.key
        gone = keys_gone(self.read(), self._owned().select(F.col(self._owner_key()).alias(key)), key).select(key)
        self.store.change(self.spec.mirror, gone, lambda now: remove(now, gone, key), "prune")

    def flush(self) -> None:
        self.store.flush(self.spec.mirror)


def _seen(observed: Observation) -> int:
    """The observed count; 0 where the planner found that nothing comes by."""
    try:
        return observed.get["n"]
    except Py4JJavaError:
        return 0


ACTIONS = ("sync", "remove", "erase")


def change_rows(rows: DataFrame, key: str, action: str = "sync", seq: int | None = None) -> DataFrame:
    """Changes that ask for the rows of a query to be mirrored, or, with remove, not to be; seq orders the changes, by
    default as they are made."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    return rows.select(F.col(key).alias("key"), F.lit(action).alias("action"), F.lit(time.time_ns() if seq is None else seq).cast("long").alias("seq"))


def captured(before: DataFrame, after: DataFrame, key: str, soft_delete: str | None = None, seq: int | None = None) -> DataFrame:
    """Changes between two states of an owner table: keys that came or differ in any column are to be synced, keys that went
    are to be removed. soft_delete: a column that isn't null in deleted rows, which are removed too."""
    alive = lambda df: df.where(F.col(soft_delete).isNull()) if soft_delete else df
    state = lambda df: alive(df).select(F.col(key).alias("key"), F.xxhash64(*sorted(df.columns)).alias("state"))
    both = state(before).withColumnRenamed("state", "old").join(state(after).withColumnRenamed("state", "new"), "key", "full_outer")
    action = F.when(F.col("new").isNull(), "remove").otherwise("sync")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("key", action.alias("action"), F.lit(time.time_ns() if seq is None else seq).cast("long").alias("seq"))


class Owner:
    """An owner table in a store that logs the changes of its writes for its mirrors.

    The owner's snapshot comes first and names the state; the changes that lead to it are written under the snapshot's
    number, so a writer that stops in between is caught up by `capture`, and nothing is logged twice.
    """

    def __init__(self, store: SnapshotStore, table: str, key: str = "id", soft_delete: str | None = None):
        self.store, self.table, self.key, self.soft_delete = store, table, key, soft_delete

    @property
    def log(self) -> str:
        return f"{self.table}_changes"

    def write(self, rows: DataFrame, op: str = "write") -> None:
        """The rows are the table's new state."""
        self.store.commit(self.table, rows, op)
        self.capture()

    def capture(self) -> int:
        """Logs the changes of the snapshots that aren't in the log yet; how many these were."""
        logged = self.store.last(self.log)
        done = logged.applied.get(self.table, 0) if logged else 0
        new = [i for i in self.store.ids(self.table) if i > done]
        for i in new:
            after = self.store.read(self.table, id=i)
            before = self.store.read(self.table, id=i - 1) if i - 1 in self.store.ids(self.table) else after.limit(0)
            self.store.append(self.log, captured(before, after, self.key, self.soft_delete, i), "capture", (self.table, i))
        return len(new)

    def changes(self) -> DataFrame:
        """(key, action, seq) of all writes; seq is the snapshot's number."""
        return self.store.read(self.log)

    def pending(self, mirror: Mirror) -> DataFrame:
        """The changes that the mirror hasn't applied."""
        return self.changes().where(F.col("seq") > self._applied(mirror))

    def _applied(self, mirror: Mirror) -> int:
        last = mirror.store.last(mirror.spec.mirror)
        return last.applied.get(self.log, 0) if last else 0

    def mirror(self, mirror: Mirror) -> int:
        """Applies what is pending, once; the number of the last snapshot that the mirror has now."""
        from ..streaming.apply import last_actions

        upto = self.store.at(self.table).id
        if upto > self._applied(mirror):
            mirror.apply(last_actions(self.pending(mirror).where(F.col("seq") <= upto)), (self.log, upto))
        return upto

    def statistics(self, mirror: Mirror) -> dict:
        """What waits for the mirror: changes and keys pending, and snapshots of the owner that aren't in the log."""
        logged = self.store.last(self.log)
        done = logged.applied.get(self.table, 0) if logged else 0
        waiting = self.pending(mirror).agg(F.count("*").alias("changes"), F.countDistinct("key").alias("keys")).first() if logged else (0, 0)
        return {"changes": waiting[0], "keys": waiting[1], "uncaptured": sum(i > done for i in self.store.ids(self.table))}
