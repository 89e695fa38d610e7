"""Near-duplicate documents by SimHash candidates that are held to the texts.

Texts become sets of word shingles; equal sets are one node. A node has a 128-bit SimHash of its set. Sets of a Jaccard
similarity of `least` differ in size by that share at most, so tiles hold nodes of one size class and one band of
population counts, and tiles are compared (exclusive-or, bit counts) only if their classes are neighbours and their
bands' counts don't differ beyond the radius. Each pair of tiles gives what its candidate links join.

A candidate link may be false, so each connected component of candidates (a family) is held to the texts: its texts are
brought together once, and within it every link within the radius between nodes that aren't joined yet is compared
set by set. No link is lost whatever the false ones. A family that is too large for one place is dealt into blocks: links
within blocks come first, then links between the blocks' components' representatives, then each block of what the
family's largest component still lacks meets all its blocks. Only the texts of families travel: a bitmap of fixed size
picks them where they lie, and another passes the rows by that no decision is about.

Defined results: null and empty texts are the same empty set, which is like itself only; fewer than `width` words are one
shingle; of a class of near-duplicates the row with the smallest id stays (null last, then by the text's hash), and of
rows alike in id and text one; ids are of any type with an order; other columns, whatever their names, are carried
unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Scratch, bitmap, byte_texts, slices, with_hit
from .components import components
from .simhash import majority, shingles_of, stars, tile_pairs, tiled, words_of

#: Five-word shingles, as sets. Two sets with a Jaccard similarity of 0.8 have a cosine of 0.889, so 19.4 of 128 bits are
#: expected to differ, with a deviation of 4; RADIUS leaves three deviations.
SHINGLE, RADIUS, SIMILARITY = 5, 32, 0.8
#: Population counts in a band.
BAND = 16
#: Nodes and shingles of a block of a family, about.
GROUP, GROUP_SHINGLES = 4096, 1 << 19


def size_classes(least: float, most: int = 1 << 31) -> list[int]:
    """The smallest sizes of the classes: sizes two classes apart differ by more than the share `least`."""
    bounds = [0, 1]
    while bounds[-1] < most:
        bounds.append(int(bounds[-1] / least * (1 + 1e-9)) + 1)
    return bounds


def marked(docs: DataFrame, key: str, text: str, width: int, least: float) -> DataFrame:
    """(k1, k2, id, node, fp0, fp1, size, cell) of each row: hashes of its id and text, its set's name, fingerprint and
    size, and the cell of its size class and band."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(key).alias("k1"), F.xxhash64(body).alias("k2"), F.col(key).alias("id"), body.alias("text"))
    bounds = size_classes(least)

    def batches(parts):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh128_digest

        for batch in parts:
            for part in slices(batch):
                nodes, fps, sizes = [], [], []
                for x in byte_texts(part):
                    digests = sorted({xxh128_digest(s, simhash.SEED) for s in shingles_of(words_of(x), width)})
                    joined = b"".join(digests)
                    nodes.append(xxh128_digest(joined))
                    fps.append(majority(np.frombuffer(joined, dtype=np.uint8).reshape(-1, 16)))
                    sizes.append(len(digests))
                fps, sizes = np.array(fps, dtype=np.uint64).reshape(-1, 2), np.array(sizes, dtype=np.int64)
                bands = np.bitwise_count(fps).sum(axis=1, dtype=np.int64) // BAND
                cells = (np.searchsorted(bounds, sizes, side="right") - 1) * 64 + bands
                columns = [pa.array(nodes, pa.binary()), *(pa.array(fps[:, i].view(np.int64)) for i in (0, 1)), pa.array(sizes.astype(np.int32)), pa.array(cells)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("k1", "k2", "id")), *columns], names=["k1", "k2", "id", "node", "fp0", "fp1", "size", "cell"])

    return rows.mapInArrow(batches, f"k1 long, k2 long, id {rows.schema['id'].dataType.simpleString()}, node binary, fp0 long, fp1 long, size int, cell long")


def candidates(nodes: DataFrame, radius: int, least: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes that join all that candidate links join: a star for each component of each pair of tiles."""
    # at most 100 size classes x 9 bands: broadcast
    cells = nodes.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / simhash.TILE).cast("int").alias("tiles"))
    dealt = nodes.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    own = {"fp0": "<i8", "fp1": "<i8", "size": "<i4"}
    tiles = scratch.keep(tiled(dealt, own, ["node"]), "tiles")
    apart = [d for d in range(9) if max(d - 1, 0) * BAND + min(d, 1) <= radius]
    steps = [(0, d) for d in apart] + [(1, s * d) for d in apart for s in (1, -1) if d or s == 1]
    near = cells.select("cell", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(d).alias("d")) for c, d in steps])).alias("o"))
    near = near.where((F.col("cell") % 64 + F.col("o.d")).between(0, 63)).select("cell", (F.col("cell") + 64 * F.col("o.c") + F.col("o.d")).alias("other"))

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for same, *sides in zip(*(batch.column(i).to_pylist() for i in range(9))):
                both = []
                for f0, f1, size, names in (sides[:4], sides[4:]):
                    both.append((np.stack([np.frombuffer(f, "<u8") for f in (f0, f1)], axis=1), np.frombuffer(size, "<i4"), names))
                (a, p, names), (b, q, more) = both
                x, y = stars(a, b, same, radius, (p, q), least)
                if len(x):
                    names = names if same else names + more
                    yield pa.RecordBatch.from_arrays([pa.array([names[16 * i : 16 * i + 16] for i in v.tolist()], pa.binary()) for v in (x, y)], names=["a", "b"])

    return tile_pairs(tiles, F.broadcast(near), [*own, "node"]).mapInArrow(compare, "a binary, b binary")


def linked(fps, sides, labels, sets, radius: int, least: float) -> list[tuple[int, int]]:
    """Pairs that join all that the links of a group join which are within radius and whose sets (sorted arrays) have a
    Jaccard similarity of `least` at least: links between sides 0 and 1, or within side 0 if there is no other. All links
    but those between nodes that are joined already, or have equal labels, are held to the sets."""
    import numpy as np

    n, least = len(sets), least * (1 - 1e-12)  # rounding must not lose a link
    root = np.unique(labels, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    kinds, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[flat] > 1  # shingles of one set only are in no intersection
    upto = np.concatenate([[0], np.cumsum(common)])
    ends = np.cumsum(sizes)
    shared = upto[ends] - upto[ends - sizes]
    flat, begins = flat[common], np.cumsum(shared) - shared
    able = (shared >= least * sizes) & (shared > 0)
    one = not (sides == 1).any()
    rows, others = np.nonzero(able & (sides == 0))[0], np.nonzero(able & (sides == (0 if one else 1)))[0]
    mark = np.zeros(len(kinds), dtype=bool)
    joined = np.zeros(n, dtype=bool)
    for i, x in enumerate(rows.tolist()):
        y = others[i + 1 :] if one else others
        y = y[root[y] != root[x]]
        y = y[np.bitwise_count(fps[y] ^ fps[x]).sum(axis=1, dtype=np.int64) <= radius]
        y = y[np.minimum(sizes[y], sizes[x]) >= least * np.maximum(sizes[y], sizes[x])]
        if not len(y):
            continue
        own = flat[begins[x] : begins[x] + shared[x]]
        mark[own] = True
        for part in np.split(y, np.nonzero(np.diff(np.cumsum(shared[y]) >> 18))[0] + 1):
            ends = np.cumsum(shared[part])
            at = np.arange(ends[-1]) + np.repeat(begins[part] - ends + shared[part], shared[part])
            both = np.diff(np.concatenate([[0], np.cumsum(mark[flat[at]])])[np.concatenate([[0], ends])])
            for z in part[both >= least * (sizes[x] + sizes[part] - both)].tolist():
                if root[z] != root[x]:
                    root[root == root[z]] = root[x]
                    joined[[x, z]] = True
        mark[own] = False
    some = np.nonzero(joined)[0]
    _, first, whose = np.unique(root[some], return_index=True, return_inverse=True)
    return [(x, y) for x, y in zip(some[first[whose]].tolist(), some.tolist()) if x != y]


def held_to_texts(groups: DataFrame, width: int, radius: int, least: float) -> DataFrame:
    """Links (a, b) that join what the true links of each group join, for rows (family, g1, g2, side, label, node, fp0, fp1,
    text); a group is a (family, g1, g2) of bounded size."""
    by = ["family", "g1", "g2"]
    dealt = groups.select(*by, "side", "node", "label", "fp0", "fp1", "text").repartition(*by).sortWithinPartitions(*by, "side", "node")

    def judge(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        def result(held):
            nodes, sides, labels, fps, sets = zip(*held)
            number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
            labels = np.array([number[x] for x in labels])
            found = linked(np.array(fps, dtype=np.int64).view(np.uint64), np.array(sides), labels, sets, radius, least)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i[k]] for i in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        at, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for family, g1, g2, side, node, label, fp0, fp1, body in zip(*columns, byte_texts(batch)):
                if (family, g1, g2) != at and held:
                    yield result(held)
                    held = []
                at = (family, g1, g2)
                found = set(map(xxh3_64_intdigest, shingles_of(words_of(body), width)))
                held.append((node, side, label, (fp0, fp1), np.array(sorted(found), dtype=np.uint64)))
        if held:
            yield result(held)

    return dealt.mapInArrow(judge, "a binary, b binary")


def with_texts(members: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """members (k1, k2, ...) with the text of one of the rows with these hashes; a bitmap picks the rows that may be theirs."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(key).alias("k1"), F.xxhash64(body).alias("k2"), body.alias("text")).withColumn("k", F.xxhash64("k1", "k2"))
    rows = with_hit(rows, "k", bitmap(members.select(F.xxhash64("k1", "k2")))).where("hit").select("k1", "k2", "text")
    return members.join(rows.dropDuplicates(["k1", "k2"]).hint("merge"), ["k1", "k2"])


def _blocks(nodes, shingles):
    return F.ceil(F.greatest(nodes / GROUP, shingles / GROUP_SHINGLES)).cast("int")


def _dealt(blocks):
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def true_links(nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, radius: int, least: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the nodes (node, fp0, fp1, size, cell, k1, k2) that join all that links within radius and similarity join."""
    families = components(candidates(nodes, radius, least, scratch), "binary")
    members = nodes.join(families.hint("merge"), "node").withColumnRenamed("root", "family")
    members = scratch.keep(members.select("node", "family", "fp0", "fp1", "size", "k1", "k2"), "members")
    scratch.drop("tiles")
    blocks = members.groupBy("family").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks"))
    large = scratch.keep(blocks.where("blocks > 1"), "large")
    none = F.lit(0)

    def judged(groups: DataFrame, name: str) -> DataFrame:
        return scratch.keep(held_to_texts(with_texts(groups, docs, key, text), width, radius, least), name)

    mine = members.join(large, "family", "left").withColumn("g1", _dealt(F.coalesce("blocks", F.lit(1)))).withColumns({"g2": none, "side": none, "label": F.col("node")})
    found = judged(mine, "links-1")
    if not large.head(1):
        return found
    # representatives of the components so far, one each
    some = members.join(large, "family", "left_semi")

    def labelled(links):
        own = components(links, "binary").select("node", "root")
        return some.join(own.hint("merge"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")

    now = scratch.keep(labelled(found), "labelled-1")
    least_of = now.groupBy("label").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n > 1").select("node")
    stand = now.join(least_of.hint("merge"), "node", "left_semi")
    few = stand.groupBy("family").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks"))
    stand = stand.join(few, "family").withColumn("g1", _dealt(F.col("blocks"))).withColumns({"g2": none, "side": none})
    found = found.unionAll(judged(stand, "links-2"))
    # what a family's largest component lacks meets itself and that component, block by block
    now = scratch.keep(labelled(found), "labelled-2")
    sizes = now.groupBy("family", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    total = sizes.groupBy("family").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "label")).alias("m"))
    main = _blocks(F.col("m.n"), F.col("m.s")).alias("main")
    rest = _blocks(F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")).alias("rest")
    plan = total.where("n > m.n").select("family", F.col("m.label").alias("most"), main, rest)
    now = now.join(plan, "family").withColumn("b", F.when(F.col("label") == F.col("most"), F.col("rest") + _dealt(F.col("main"))).otherwise(_dealt(F.col("rest"))))
    row = lambda side, g1, g2: F.struct(F.lit(side).alias("side"), g1.alias("g1"), g2.alias("g2"))
    b, every = F.col("b"), F.col("rest") + F.col("main")
    to_all = F.transform(F.sequence(b, every - 1), lambda j: row(0, b, j))  # a rest block with itself and those after it
    to_before = F.transform(F.sequence(F.lit(0), F.least(b, F.col("rest")) - 1), lambda i: row(1, i, b))
    is_main = b >= F.col("rest")
    places = F.when(is_main, to_before).when(b == 0, to_all).otherwise(F.concat(to_all, to_before))
    met = now.withColumn("p", F.explode(places)).select("node", "family", "label", "fp0", "fp1", "k1", "k2", "p.side", "p.g1", "p.g2")
    return found.unionAll(judged_again(met, docs, key, text, width, radius, least, scratch))


def judged_again(met: DataFrame, docs: DataFrame, key: str, text: str, width: int, radius: int, least: float, scratch: Scratch) -> DataFrame:
    """Links of groups that a node stands in more than once: its text is fetched once and meets its places after that."""
    texts = scratch.keep(with_texts(met.select("k1", "k2").distinct(), docs, key, text), "texts")
    return scratch.keep(held_to_texts(met.join(texts.hint("merge"), ["k1", "k2"]), width, radius, least), "links-3")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """(k1, k2, id, first1, first2, alone) of each row: hashes of its id and its text, its id, those of the row that stays
    of its class, and whether it is the only row of its class."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(marked(docs, key, text, width, least), "marked")
    first = F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("k2"), F.col("k1"))).alias("first")
    nodes = rows.groupBy("node").agg(first, F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("fp0", "fp1", "size", "cell")])
    nodes = scratch.keep(nodes.withColumns({"k1": F.col("first.k1"), "k2": F.col("first.k2")}), "nodes")
    links = true_links(nodes, docs, key, text, width, radius, least, scratch)
    found = components(links, "binary")
    rooted = scratch.keep(nodes.join(found.hint("merge"), "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    named = rooted.select("node", "root").join(named.hint("merge"), "root").select("node", F.col("first.k1").alias("first1"), F.col("first.k2").alias("first2"), (F.col("n") == 1).alias("alone"))
    return rows.select("k1", "k2", "id", "node").join(named.hint("merge"), "node").drop("node")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE, radius: int = RADIUS, least: float = SIMILARITY) -> DataFrame:
    """docs' rows without near-duplicates: of each class one stays. Rows that are alone in their class stay where they lie."""
    scratch = Scratch(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(key).alias("k1"), F.xxhash64(body).alias("k2")).withColumn("k", F.xxhash64("k1", "k2"))
    stays = (F.col("k1") == F.col("first1")) & (F.col("k2") == F.col("first2"))
    told = classes(docs, key, text, width, radius, least).where(~F.col("alone"))
    told = scratch.keep(told.groupBy("k1", "k2").agg(F.max(stays).alias("stays")), "told")
    split = with_hit(rows, "k", bitmap(told.select(F.xxhash64("k1", "k2"))))
    some = split.where("hit").select("row", "k1", "k2").dropDuplicates(["k1", "k2"])  # alone, or all copies of a row
    some = some.join(told.hint("merge"), ["k1", "k2"], "left").where("stays is null or stays")
    kept = split.where("not hit").select("row").unionAll(some.select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
