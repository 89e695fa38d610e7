"""Shared helpers: reading tables, cutting lineage in the shared folder, bitmaps of keys, byte-level word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
#: Texts are handled in slices of about so many bytes inside a Python worker.
SLICE_BYTES = 4 << 20
#: and of no more than so many, so that a text's number in a slice fits into 16 bits.
SLICE_ROWS = 1 << 15
#: Bytes of an Arrow batch, about: the JVM and the worker hold one each, besides the one under way.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: A worker's cache by word is emptied beyond so many entries, and words of more bytes or characters aren't kept: some
#: 40 MB at most.
CACHE_ENTRIES, CACHE_LENGTH = 200_000, 64
#: Bits of a bitmap of keys: at most 2**16 rows of BITMAP_WORDS longs, 8 MB, whatever the number of keys.
BITMAP_BITS = 1 << 26
BITMAP_WORDS = 16


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, which long texts and packed rows would fill without end, unless the session does."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="portolan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no more than the unfinished stage.

    Steps drop what no later one reads; what a returned DataFrame still reads goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        self.spark, self.root, self.held = spark, f"{shared_dir(spark)}/portolan-{uuid.uuid4().hex}", False

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        if not self.held:
            root, files = self._path()
            self.held = files.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._path(name)
            files.delete(path, True)


def _bit(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BITMAP_BITS))


def bitmap(hashes: DataFrame) -> DataFrame:
    """(chunk, words) of the bitmap that has a bit set for each hash (the first column): built by map-side ORs."""
    bit = hashes.select(_bit(F.col(hashes.columns[0])).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    word = F.floor(F.col("bit") / 64) % BITMAP_WORDS
    words = F.array(*[F.coalesce(F.bit_or(F.when(word == k, one)), F.lit(0).cast("long")) for k in range(BITMAP_WORDS)])
    return bit.groupBy(F.expr(f"bit div {64 * BITMAP_WORDS}").alias("chunk")).agg(words.alias("words"))


def with_hit(df: DataFrame, hashed: str, bits: DataFrame) -> DataFrame:
    """df with the boolean `hit`: whether the bitmap has the hash's bit, as it has for all hashes that it was made of and
    for a few others. The bitmap is broadcast: its size is bounded."""
    bit = _bit(F.col(hashed))
    found = df.withColumn("b_bit", bit).join(F.broadcast(bits), F.expr(f"b_bit div {64 * BITMAP_WORDS}") == F.col("chunk"), "left")
    word = F.get("words", (F.floor(F.col("b_bit") / 64) % BITMAP_WORDS).cast("int"))
    hit = F.coalesce(F.getbit(word, (F.col("b_bit") % 64).cast("int")), F.lit(0)) == 1
    return found.withColumn("hit", hit).drop("b_bit", "chunk", "words")


def slices(batch, column: str = "text", size: int = SLICE_BYTES):
    """Parts of an Arrow batch that hold about `size` bytes of text each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes + size // SLICE_ROWS, dtype=np.int64) // size
    edges = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def byte_texts(batch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]
