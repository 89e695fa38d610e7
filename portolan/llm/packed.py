"""Packed exchanges: what a slice of texts sends to a bucket of names travels as one row of binary columns.

A name is a 64-bit hash and its bucket a remainder of it, so all slices send a name to the same bucket; a bucket's
answers go back by the slice's id. Rows are sorted within a partition, so only one bucket or slice is held at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def pack(slice_id: int, bucket: int, **blobs):
    import pyarrow as pa

    columns = [pa.array([bucket], pa.int32()), pa.array([slice_id], pa.int64())]
    columns += [pa.array([x.tobytes() if x is not None else None], pa.binary()) for x in blobs.values()]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "slice", *blobs])


def read_rows(batch, *names):
    """The rows of a batch with their blobs as they are."""
    return zip(*(batch.column(x).to_pylist() for x in names))


def by_bucket(bucket, buckets: int, slice_id: int, first: dict | None = None, **columns):
    """Rows of the columns' entries by bucket; first: columns put before them."""
    import numpy as np

    bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = {k: v[order] for k, v in columns.items()}
    for b in np.nonzero(np.diff(edges))[0].tolist():
        yield pack(slice_id, b, **(first or {}), **{k: v[edges[b] : edges[b + 1]] for k, v in columns.items()})


def runs(batches, by: str, names: list[str]):
    """Lists of rows with the same value of `by`, which the rows are sorted by."""
    held, at = [], None
    for batch in batches:
        for row in read_rows(batch, by, *names):
            if row[0] != at and held:
                yield at, held
                held = []
            at = row[0]
            held.append(row[1:])
    if held:
        yield at, held


def bucket_count(docs: DataFrame) -> int:
    """Buckets that names are dealt into: four for each input partition, a power of two from 64 to 2**20."""
    return min(1 << 20, max(64, 1 << (4 * docs.rdd.getNumPartitions() - 1).bit_length()))
