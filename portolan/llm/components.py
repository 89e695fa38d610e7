"""Connected components of a link table by alternating large-star and small-star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, kind: str) -> DataFrame:
    """(node, root) for every node of links (a, b): root is its component's smallest node, in the order of the type `kind`.

    Each round is written to the shared folder. A step's groups are a node's neighbours: the minimum is aggregated map-side
    and joined back, so no group is gathered in one task.
    """
    scratch = Scratch(links.sparkSession)
    links = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links-0")
    step, before = 0, None
    while True:
        # large star: every larger neighbour of a node is linked with the least of the node and its neighbours
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node and its smaller neighbours are linked with the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        own = least.select(F.col("k").alias("a"), F.col("m").alias("b"))
        step += 1
        seen = Observation()  # counted as it is written
        new = small.union(own).distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        links = scratch.keep(new, f"links-{step}")
        scratch.drop(f"links-{step - 1}")
        now = seen.get
        if now == before:
            break
        before = now
    return links.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("root")).union(
        links.select(F.col("b").cast(kind).alias("node"), F.col("b").cast(kind).alias("root")).distinct()
    )
