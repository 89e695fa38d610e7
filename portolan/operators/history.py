"""Valid-time history: an event log and the intervals that follow from it.

Events are rows (key, at, seq, erase, row): row is null where the key was deleted at that time, erase says that the key's
whole history goes. An event holds from its time to the next event of the key; of events at the same time, the one of
the largest seq stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def append_events(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log with the events: erased keys lose what was logged before and what else the batch has of them."""
    erased = events.where("erase").select("key").distinct()
    both = log.unionByName(events.where("not erase"))
    return both.join(erased, "key", "left_anti").select(*log.columns)


def not_older(log: DataFrame, events: DataFrame) -> DataFrame:
    """The events without those of keys that the log has a newer version of: for stores that keep the latest state."""
    newest = log.where("not erase").groupBy("key").agg(F.max("at").alias("__newest"))
    known = events.join(newest, "key", "left")
    return known.where(F.col("__newest").isNull() | (F.col("__newest") <= F.col("at"))).select(*events.columns)


def intervals(log: DataFrame) -> DataFrame:
    """(key, row, _valid_from, _valid_to) of the log's existing versions, half open, the last one without an end."""
    same = Window.partitionBy("key", "at").orderBy(F.desc("seq"))
    one = log.where("not erase").withColumn("__r", F.row_number().over(same)).where("__r = 1")
    ends = one.withColumn("__to", F.lead("at").over(Window.partitionBy("key").orderBy("at")))
    return ends.where("row is not null").select("key", "row", F.col("at").alias("_valid_from"), F.col("__to").alias("_valid_to"))


def as_of_valid_time(history: DataFrame, time) -> DataFrame:
    t = F.lit(time).cast("timestamp")
    return history.where((F.col("_valid_from") <= t) & (F.col("_valid_to").isNull() | (F.col("_valid_to") > t)))


def valid_between(history: DataFrame, start, end) -> DataFrame:
    """Versions that hold at some time from start to before end."""
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return history.where((F.col("_valid_from") < b) & (F.col("_valid_to").isNull() | (F.col("_valid_to") > a)))


def for_all_valid_time(history: DataFrame) -> DataFrame:
    return history.orderBy("key", "_valid_from")


def current(history: DataFrame) -> DataFrame:
    return history.where("_valid_to is null")


def as_events(rows: DataFrame, key: str, valid_time: str | None, seq: str) -> DataFrame:
    """Rows of versions as events; a missing valid time is now."""
    at = F.coalesce(F.col(valid_time).cast("timestamp"), F.current_timestamp()) if valid_time and valid_time in rows.columns else F.current_timestamp()
    return rows.select(F.col(key).alias("key"), at.alias("at"), F.col(seq).cast("long").alias("seq"), F.lit(False).alias("erase"), F.struct(*rows.columns).alias("row"))
