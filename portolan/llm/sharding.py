"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is its text's hash, so equal texts lie together; each virtual node owns the arc that ends at
it. Rows enter in ring order: by arc, place, then a hash of their id, then their own columns. A row goes to its arc's
shard while that has room, else clockwise to the next virtual node whose shard has. With law `rows` the capacities are
the row count dealt as evenly as whole numbers allow, so that counts are at most one apart.

Only counts an arc reach the driver: shards x vnodes numbers. What an arc's rows get follows from their rank in the
arc: a few (from, to, shard, first slot) segments, shards x vnodes + shards at most, which are broadcast. Ranks come
from the order alone, however the rows are dealt: rows alike in all that is read are one with a count, these are dealt by
ranges of the order, each range is ranked by itself, and the ranges' totals give what lies before it. So a hot text, and
even rows that are alike, are spread over tasks.

Defined results: a null text is empty (size 1, CRC 0); null doc_ids and repeated rows are rows like any other; an empty
table gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SHARDS = 8
VNODES = 128
#: The ring has 2**63 places; a lookup table of 2**CELL_BITS rows tells the nodes near a place.
CELL_BITS = 12
#: Rows that one task ranks, about, and copies of a row that one task writes at most.
RANGE_ROWS = 1 << 20


def _mix(x: int) -> int:
    """A 64-bit finaliser (the public splitmix64)."""
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes in ring order; a shard's own don't depend on the other shards."""
    places: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            places.setdefault(_mix(shard << 32 | v) >> 1, shard)
    return sorted(places.items())


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(nodes: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, from, to, shard, slot of the first): ranks from..to-1 of an arc's rows go to the shard."""
    full_at, used, out = list(room), [0] * len(room), []
    for arc in range(len(nodes)):
        left, rank, step = counts.get(arc, 0), 0, arc
        while left:
            shard = nodes[step % len(nodes)][1]
            take = min(left, full_at[shard])
            if take:
                out.append((arc, rank, rank + take, shard, used[shard]))
                used[shard] += take
                full_at[shard] -= take
                rank, left = rank + take, left - take
            step += 1
    return out


def with_arc(rows: DataFrame, nodes: list[tuple[int, int]]) -> DataFrame:
    """rows (place, ...) with `arc`, the number of the first node at or after the place, the first of all after the last."""
    starts = [p for p, _ in nodes]
    edges = [bisect_left(starts, cell << 63 - CELL_BITS) for cell in range((1 << CELL_BITS) + 1)]
    near = [(cell, a, starts[a:b]) for cell, (a, b) in enumerate(zip(edges, edges[1:]))]
    near = rows.sparkSession.createDataFrame(near, "cell int, base int, inside array<long>")  # 2**CELL_BITS rows: broadcast
    cell = F.shiftright("place", 63 - CELL_BITS).cast("int")
    found = rows.withColumn("cell", cell).join(F.broadcast(near), "cell")
    before = F.size(F.filter("inside", lambda p: p < F.col("place")))
    return found.withColumn("arc", (F.col("base") + before) % len(nodes)).drop("cell", "base", "inside")


def bounded_ring(rows: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """rows (doc_id, size, text_crc32, place) with shard and slot, the slots of a shard gapless from 0."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    nodes = ring(shards, vnodes)
    order = ["arc", "place", "tie", "doc_id", "text_crc32", "size"]
    placed = with_arc(rows, nodes).withColumn("tie", F.xxhash64("doc_id"))
    placed = scratch.keep(placed.groupBy(*order).agg(F.count("*").alias("n")), "placed")
    counts = {r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # one row an arc
    segments = fill(nodes, counts, capacities(sum(counts.values()), shards))
    ranges = max(1, -(-placed.count() // RANGE_ROWS))
    ranged = scratch.keep(placed.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranged")
    scratch.drop("placed")
    here = ranged.groupBy("arc", "range").agg(F.sum("n").alias("here"))  # ranges + arcs rows
    here = here.withColumn("before", F.sum("here").over(Window.partitionBy("arc").orderBy("range")) - F.col("here")).drop("here")
    upto = F.sum("n").over(Window.partitionBy("arc", "range").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.withColumn("upto", upto).join(here, ["arc", "range"]).withColumn("rank", F.col("before") + F.col("upto") - F.col("n"))
    # copies of a row: first in stretches, then one by one
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RANGE_ROWS}"))).alias("stretch")
    many = ranked.where(f"n > {RANGE_ROWS}").select("*", stretch).repartition("rank", "stretch")
    each = ranked.where(f"n <= {RANGE_ROWS}").withColumn("stretch", F.lit(0).cast("long")).unionByName(many)
    first = F.col("stretch") * RANGE_ROWS
    copy = F.explode(F.sequence(first, F.least(first + RANGE_ROWS, F.col("n")) - 1)).alias("copy")
    each = each.select("doc_id", "size", "text_crc32", "arc", "rank", copy).withColumn("rank", F.col("rank") + F.col("copy"))
    segments = spark.createDataFrame(segments, "s_arc int, from long, to long, shard int, first long")
    on = (F.col("arc") == F.col("s_arc")) & (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to"))
    return each.join(F.broadcast(segments), on).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("from")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, key: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), body.alias("body"))
    rows = rows.select(
        "doc_id", (F.octet_length("body") + 1).cast("long").alias("size"),
        F.crc32("body").alias("text_crc32"), F.shiftrightunsigned(F.xxhash64("body"), 1).alias("place"),
    )
    return bounded_ring(rows, shards, vnodes)


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
