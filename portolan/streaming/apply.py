"""Change streams into mirrors: micro-batches of keys, applied once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import append_events
from ..operators.mirror import Mirror
from ..sources.store import SnapshotStore


def last_actions(batch: DataFrame) -> DataFrame:
    """(key, action): the last action of each key by `seq`; where the changes have no seq, or equal ones, sync comes after
    remove, since it asks the owner. An erase isn't taken back."""
    rank = F.when(F.col("action") == "remove", 0).when(F.col("action") == "sync", 1).otherwise(2)
    seq = F.col("seq").cast("long") if "seq" in batch.columns else F.lit(0).cast("long")
    word = F.struct((F.col("action") == "erase").alias("erase"), F.coalesce(seq, F.lit(0).cast("long")).alias("seq"), rank.alias("rank"), F.col("action").alias("action"))
    return batch.groupBy("key").agg(F.max(word).alias("word")).select("key", "word.action")


def apply_changes(changes: DataFrame, mirror: Mirror, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Runs the stream of (key, action) or (key, action, seq) into the mirror, as far as it has come.

    A key that waits more than once in a batch is written once. A batch that was committed already isn't applied again, so
    replays don't matter.
    """

    def one(batch: DataFrame, number: int) -> None:
        mirror.apply(last_actions(batch), (checkpoint, number))

    writer = changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def apply_versions(events: DataFrame, store: SnapshotStore, table: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream of events into a history log, every version kept. A batch without erasures is added to the log's
    files; one that erases rewrites the log, so that what was erased is in no current file."""

    def one(batch: DataFrame, number: int) -> None:
        tag = (checkpoint, number)
        if not store.exists(table):
            store.commit(table, append_events(batch.limit(0), batch), "versions", tag)
        elif batch.where("erase").isEmpty():
            store.append(table, batch.select(*store.read(table).columns), "versions", tag)
        else:
            now = store.at(table)
            store.commit(table, append_events(store.read(table, id=now.id), batch), "erase", tag, parent=now.id)

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """What the last micro-batch did: rows in, and how long it took."""
    last = query.lastProgress
    if not last:
        return {"batch": None, "rows": 0, "ms": 0}
    return {"batch": last["batchId"], "rows": last["numInputRows"], "ms": last["durationMs"].get("triggerExecution", 0)}
