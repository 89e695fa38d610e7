"""SimHash near-duplicate detection by tiled exact comparison.

Fingerprints are laid out in tiles of equal population counts: the 64 bits are cut into `parts` equal parts, and a
tile holds fingerprints with the same count of set bits in each part. Two tiles are compared only if their counts
differ by no more than the radius in all; a larger difference proves that no pair of theirs links. Tiles are compared
with numpy: exclusive-or, then bit counts. A pair of tiles gives what its links join, each node with the first of its
component, not the links themselves, so copies never expand into pairs, and no link between components is lost.

Equal fingerprints are one node. Tiles are packed into binary rows of TILE fingerprints at most; the counts' cells that
hold more are cut into several tiles. near_dedup.py lays out wide fingerprints in the same tiles.

Defined results: a text without words has fingerprint zero, linked like any other; null is such a text; null keys
come last, so they name a component only if it has no other; repeated rows return as often as they occur; other
columns, whatever their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_texts, slices, table
from .components import components

TILE = 4096
#: Rows of a tile that numpy compares at once with the whole other tile.
STRIP = 64
SEED = 42


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return text.lower().split()


def shingles_of(words: list[bytes], width: int) -> list[bytes]:
    """The runs of `width` words, joined by a space; of fewer words all, of none none."""
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(width)])))


def majority(h):
    """For each bit column of the hashes h (rows of bytes) whether it is set in over half of them, as 64-bit numbers."""
    import numpy as np

    ones = np.zeros(8 * h.shape[1], dtype=np.int64)
    for a in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[a : a + (1 << 14)], axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(h)).view(">u8").astype(np.uint64)


def fingerprint(words: list[bytes], width: int, seed: int = SEED):
    """The bits set in over half of the XXH64s of the word shingles, repeats included, as one 64-bit number in an array."""
    import numpy as np
    from xxhash import xxh64_digest

    found = shingles_of(words, width)
    return majority(np.frombuffer(b"".join([xxh64_digest(x, seed) for x in found]), dtype=np.uint8).reshape(-1, 8))


def fingerprints(docs: DataFrame, keys: list[str], text: str, width: int, seed: int = SEED) -> DataFrame:
    """keys, and the fingerprint fp0 of each row as a signed long."""
    rows = docs.select(*keys, F.col(text).alias("text"))

    def batches(parts):
        import numpy as np
        import pyarrow as pa

        for batch in parts:
            for part in slices(batch):
                fps = [fingerprint(words_of(x), width, seed) for x in byte_texts(part)]
                fps = np.concatenate([*fps, np.zeros(0, dtype=np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(fps)], names=[*keys, "fp0"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.mapInArrow(batches, f"{kinds}, fp0 long")


def stars(a, b, same: bool, radius: int, sizes=None, least: float = 0):
    """What the links within radius between the rows of the fingerprint arrays a and b (a with itself if same) join: each
    row and the first row of its component, as two arrays of indexes into the concatenation of a and b. With sizes (of a,
    of b), a link's smaller size must be the share `least` of its larger one at least."""
    import numpy as np

    n, off = (len(a), 0) if same else (len(a) + len(b), len(a))
    root, least = np.arange(n), least * (1 - 1e-12)  # rounding must not lose a link
    for i in range(0, len(a), STRIP):
        from_ = i if same else 0
        apart = np.bitwise_count(a[i : i + STRIP, None, 0] ^ b[None, from_:, 0])
        for k in range(1, a.shape[1]):
            apart += np.bitwise_count(a[i : i + STRIP, None, k] ^ b[None, from_:, k])
        x, y = np.nonzero(apart <= radius)
        x, y = x + i, y + from_
        if sizes is not None:
            p, q = sizes[0][x], sizes[1][y]
            fits = np.minimum(p, q) >= least * np.maximum(p, q)
            x, y = x[fits], y[fits]
        y = y + off
        while len(x):
            rx, ry = root[x], root[y]
            apart_ = rx != ry
            if not apart_.any():
                break
            x, y, rx, ry = x[apart_], y[apart_], rx[apart_], ry[apart_]
            hi, lo = np.maximum(rx, ry), np.minimum(rx, ry)
            # each root takes one link to a smaller root, so roots only ever point down
            hi, first = np.unique(hi, return_index=True)
            root[hi] = lo[first]
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    x = np.nonzero(root != np.arange(n))[0]
    return x, root[x]


def tiled(dealt: DataFrame, numbers: dict[str, str], names: list[str] = ()) -> DataFrame:
    """A row (cell, tile, one binary column for each of numbers and names) for each tile of dealt: the tile's numbers by
    the little-endian type given, and its binary names one after the other, all in the order of their rows."""

    def pack(batches):
        import pyarrow as pa

        at, held = None, []

        def row():
            body = [pa.array([b"".join(x)], pa.binary()) for x in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), *body], names=["cell", "tile", *numbers, *names])

        import numpy as np

        for batch in batches:
            c, t = batch.column("cell").to_numpy(), batch.column("tile").to_numpy()
            edges = [0, *(np.nonzero((np.diff(c) != 0) | (np.diff(t) != 0))[0] + 1).tolist(), len(c)]
            columns = [batch.column(k).to_numpy().astype(kind) for k, kind in numbers.items()]
            texts = [batch.column(k) for k in names]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if (int(c[i]), int(t[i])) != at and held:
                    yield row()
                    held = []
                at = (int(c[i]), int(t[i]))
                held.append([*(x[i:j].tobytes() for x in columns), *(b"".join(x.slice(i, j - i).to_pylist()) for x in texts)])
        if held:
            yield row()

    own = [*numbers, *names]
    schema = "cell long, tile int, " + ", ".join(f"{x} binary" for x in own)
    return dealt.select("cell", "tile", *own).repartition("cell", "tile").sortWithinPartitions("cell", "tile", *own).mapInArrow(pack, schema)


def tile_pairs(tiles: DataFrame, near: DataFrame, own: list[str]) -> DataFrame:
    """(same, a_*, b_*) for each pair of tiles of the cells (cell, other) of near: pairs meet by number first, then the
    bodies join them by tile, so that no cell is gathered in one task. The joins shuffle, since tiles grow with the data."""
    names = tiles.select("cell", "tile")
    others = names.select(F.col("cell").alias("other"), F.col("tile").alias("tile2"))
    pairs = near.join(names.hint("merge"), "cell").join(others.hint("merge"), "other").where("cell <> other or tile <= tile2")
    a = tiles.select("cell", "tile", *[F.col(x).alias(f"a_{x}") for x in own])
    b = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("tile2"), *[F.col(x).alias(f"b_{x}") for x in own])
    pairs = pairs.join(a.hint("merge"), ["cell", "tile"]).join(b.hint("merge"), ["other", "tile2"])
    same = (F.col("cell") == F.col("other")) & (F.col("tile") == F.col("tile2"))
    return pairs.select(same.alias("same"), *[f"{s}_{x}" for s in "ab" for x in own])


def signature_deltas(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of the parts' counts that sum to the radius at most, one of each pair of opposites, zero included."""
    found = [((), 0)]
    for _ in range(parts):
        found = [((*d, k), s + abs(k)) for d, s in found for k in range(-(radius - s), radius - s + 1)]
    zero = (0,) * parts
    return [d for d, _ in found if d >= zero]


def parts_for(n: int, radius: int) -> int:
    """The number of parts: more as fingerprints grow in number and as the radius allows, so that cells stay small."""
    if radius > 4:  # signatures that near would take too many neighbours
        return 1
    return 2 if n < 1 << 17 else 4 if n < 1 << 24 else 8


def links(fps: DataFrame, radius: int, parts: int | None = None) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints fps (fp0), as hex strings, that join all that links join: a star for each
    component of each pair of tiles."""
    scratch = Scratch(fps.sparkSession)
    fps = scratch.keep(fps.select("fp0"), "fps")
    parts = parts or parts_for(fps.count(), radius)
    bits, base = 64 // parts, 64 // parts + 1
    weights = [base**p for p in range(parts)]
    mask = (1 << bits) - 1

    def count(p):
        if parts == 1:
            return F.bit_count("fp0")
        return F.bit_count(F.shiftrightunsigned("fp0", p * bits).bitwiseAND(F.lit(mask)))

    cell = sum((count(p).cast("long") * weights[p] for p in range(parts)), F.lit(0).cast("long"))
    fps = fps.withColumn("cell", cell)
    cells = fps.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    cells = scratch.keep(cells, "cells")
    dealt = fps.join(cells.hint("merge"), "cell").select("cell", F.pmod(F.xxhash64("fp0"), F.col("tiles")).cast("int").alias("tile"), "fp0")
    tiles = scratch.keep(tiled(dealt, {"fp0": "<i8"}), "tiles")

    # the cells that a cell may link with, itself first
    def digits(p):
        return F.expr(f"cast((cell div {weights[p]}) % {base} as int)")

    deltas = signature_deltas(parts, radius)
    near = cells.select("cell", *[digits(p).alias(f"d{p}") for p in range(parts)])
    options = [F.struct(F.lit(sum(k * w for k, w in zip(d, weights))).cast("long").alias("by"), *[F.lit(k).alias(f"k{p}") for p, k in enumerate(d)]) for d in deltas]
    near = near.select("*", F.explode(F.array(*options)).alias("o"))
    for p in range(parts):
        near = near.where((F.col(f"d{p}") + F.col(f"o.k{p}")).between(0, bits))
    near = near.select("cell", (F.col("cell") + F.col("o.by")).alias("other"))

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for same, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                a, b = (np.frombuffer(v, "<u8").reshape(-1, 1) for v in (a, b))
                x, y = stars(a, b, same, radius)
                if len(x):
                    every = (a if same else np.concatenate([a, b]))[:, 0].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([f"{every[i]:016x}" for i in v.tolist()]) for v in (x, y)], names=["a", "b"])

    return tile_pairs(tiles, near, ["fp0"]).mapInArrow(compare, "a string, b string")


def hexed():
    """The fingerprint's hex digits."""
    return F.lpad(F.lower(F.hex("fp0")), 16, "0")


def near_duplicates(docs: DataFrame, keys: list[str], text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """keys, fingerprint (hex) and least for each row; least is the smallest struct of keys (those with nulls last) of the
    rows that links reach, itself included."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.keep(fingerprints(docs, keys, text, width), "fingerprints")
    order = F.struct(*[x for k in keys for x in (F.col(k).isNull().alias(f"no_{k}"), F.col(k).alias(k))])
    ids = marked.groupBy("fp0").agg(F.min(order).alias("least"))
    found = components(links(ids, radius), "string")
    rooted = ids.select(hexed().alias("fingerprint"), "least").join(found.hint("merge"), F.col("fingerprint") == F.col("node"), "left")
    rooted = scratch.keep(rooted.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("least"))
    named = rooted.select("fingerprint", "root").join(named.hint("merge"), "root").select(F.col("fingerprint").alias("f"), F.struct(*[F.col("least")[k].alias(k) for k in keys]).alias("least"))
    marked = marked.select(*keys, hexed().alias("fingerprint"))
    return marked.join(named.hint("merge"), F.col("fingerprint") == F.col("f")).select(*keys, "fingerprint", "least")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "fingerprint", F.col("least.doc_id").alias("component_id"))
