"""SimHash, substring dedup, sharding, decontamination, licenses, against brute force."""

import collections
import datetime
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from portolan.llm import components, decontamination, licenses, sharding, simhash, substrings

SCHEMA = "doc_id long, text string"


def texts(n=120, seed=3, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 70))) for _ in range(n)]
    for _ in range(n // 2):  # copies, near copies and shared passages
        a, b = rng.choice(out).split(), rng.choice(out).split()
        cut = rng.randrange(len(a) + 1)
        out.append(" ".join(rng.choice([a, a[: cut] + ["Zz"] + a[cut:], b[: rng.randrange(len(b) + 1)] + a[cut : cut + 30] + b[:5]])))
    out += [None, "", "  ", "a", "A b", "run " * 60, "run " * 60 + "stop", "x y z", "long " * 20_000]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows + rows[:4] + [(None, out[0]), (None, None)]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = collections.Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, rows):
    prints = sorted({plain_fingerprint(t) for _, t in rows})
    root = roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    least = {}
    for d, t in rows:
        k = root[prints.index(plain_fingerprint(t))]
        least[k] = min(least.get(k, 1 << 62), 1 << 62 if d is None else d)
    want = collections.Counter((d, format(plain_fingerprint(t), "016x"), least[root[prints.index(plain_fingerprint(t))]]) for d, t in rows)
    got = simhash.near_duplicates(docs, ["doc_id"])
    assert collections.Counter((r.doc_id, r.fingerprint, r.least.doc_id) for r in got.collect()) == want
    assert simhash.near_duplicates(docs.limit(0), ["doc_id"]).count() == 0
    odd = docs.withColumns({"fp0": F.lit("x"), "least": F.lit(1), "fingerprint": F.lit(2), "node": F.lit(3)})
    assert collections.Counter((r.doc_id, r.fingerprint, r.least.doc_id) for r in simhash.near_duplicates(odd, ["doc_id"]).collect()) == want


def test_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "STRIP", 8)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60)
    fps = np.unique(np.concatenate([base, base ^ 1, base[:20] ^ 6, base[:10] ^ (1 << 50) ^ (1 << 3), rng.integers(0, 16, 40)]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp0 long")
    want = None
    for parts in (1, 2, 4, 8):
        got = sorted(map(tuple, components.components(simhash.links(df, 2, parts), "string").collect()))
        want = want or got
        assert got == want
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2])
    linked = {tuple(sorted(format(int(fps[i]), "016x") for i in range(len(fps)) if root[i] == k)) for k in set(root)}
    groups = collections.defaultdict(list)
    for node, r in got:
        groups[r].append(node)
    assert {tuple(sorted(g)) for g in groups.values()} == {g for g in linked if len(g) > 1}


def test_components(spark):
    rng = random.Random(1)
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(60) if i % 20] + [("100", f"{i}") for i in range(101, 140)] + [("005", "005")]
    rng.shuffle(links)
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a string, b string"), "string").collect()))
    names = sorted({x for ab in links for x in ab})
    root = roots(len(names), [(names.index(a), names.index(b)) for a, b in links])
    assert got == {n: names[root[i]] for i, n in enumerate(names)}


def plain_removal(rows, window=13):
    least = {}
    cut = [((t or "").encode().split()) for _, t in rows]
    for (d, _), w in zip(rows, cut):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, 1 << 63), (1 << 63) - 1 if d is None else d)
    out = []
    for (d, _), w in zip(rows, cut):
        own = (1 << 63) - 1 if d is None else d
        gone = {i + k for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < own for k in range(window)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize("bits, names", [(substrings.FILTER_BITS, substrings.MERGE_NAMES), (1 << 10, 8)])
@pytest.mark.parametrize("vocabulary", [2, 6, 40])
def test_substring_dedup(spark, bits, names, vocabulary, monkeypatch):
    """Whether the bitmap of shared anchors is sparse or full."""
    monkeypatch.setattr(substrings, "FILTER_BITS", bits)
    monkeypatch.setattr(substrings, "MERGE_NAMES", names)
    rows = texts(80, vocabulary, vocabulary)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"k1": F.lit(1), "found": F.lit("x"), "slice": F.lit(2)})
    got = substrings.substring_dedup(df)
    assert collections.Counter(map(tuple, got.collect())) == plain_removal(rows)


def test_substring_dedup_of_wider_windows(spark):
    rows = texts(60, 9, 25)
    got = substrings.substring_dedup(spark.createDataFrame(rows, SCHEMA), window=20)
    assert collections.Counter(map(tuple, got.collect())) == plain_removal(rows, 20)


def test_substring_dedup_of_nothing(docs):
    assert substrings.substring_dedup(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        substrings.substring_dedup(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


@pytest.mark.parametrize("window", [13, 20, 40])
def test_windows_are_named_by_their_symbols(window):
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 4, 50):
        cut = [rng.integers(0, kinds, rng.integers(1, 90)) for _ in range(40)]
        cut += [np.concatenate([cut[rng.integers(40)], cut[i][3:], cut[rng.integers(40)]]) for i in range(40)]
        x, sizes = np.concatenate(cut), np.array([len(c) for c in cut])
        bounds = np.cumsum(sizes) - sizes
        hashed = substrings.mix(x.astype(np.uint64))
        symbols = substrings.recompressed(hashed, bounds, window)
        assert (np.diff(symbols.left) >= 0).all() and (np.diff(symbols.right) >= 0).all()
        at = np.concatenate([np.arange(b, max(b, b + n - window + 1)) for b, n in zip(bounds, sizes)])
        names = list(zip(*(v.tolist() for v in substrings.window_names(hashed, symbols, at, window))))
        words = [tuple(x[i : i + window]) for i in at]
        assert len(set(names)) == len(set(words)) == len(set(zip(names, words)))


@pytest.mark.parametrize("window, rounds", [(13, 1), (13, 2), (32, 2), (40, 3)])
def test_anchors_depend_on_the_window_only(window, rounds):
    rng = np.random.default_rng(0)
    for kinds in (2, 3, 8, 100):
        cut = [rng.integers(0, kinds, rng.integers(1, 60)) for _ in range(60)]
        cut += [np.concatenate([cut[rng.integers(60)], cut[i][5:], cut[rng.integers(60)]]) for i in range(60)]
        x, sizes = np.concatenate(cut), np.array([len(c) for c in cut])
        name, has, whole = substrings.anchors(substrings.mix(x.astype(np.uint64)), np.cumsum(sizes) - sizes, window, None, rounds)
        assert kinds < 100 or has[whole].mean() > (0.9 if rounds == substrings.rounds_for(window) else 0)
        seen = {}
        for i in np.nonzero(whole)[0]:
            assert seen.setdefault(tuple(x[i : i + window]), (name[i], has[i])) == (name[i], has[i])


def ring_walk(rows, shards, vnodes):
    """(doc_id, size, crc, shard, slot) by walking the ring row by row."""
    nodes = sharding.ring(shards, vnodes)
    room, used, keyed, out = sharding.capacities(len(rows), shards), [0] * shards, [], []
    for d, t in rows:
        body = (t or "").encode()
        place = xxhash.xxh64_intdigest(body, 42) >> 1
        arc = sum(p < place for p, _ in nodes) % len(nodes)
        tie = 42 if d is None else int.from_bytes(xxhash.xxh64_digest(d.to_bytes(8, "little", signed=True), 42), "big", signed=True)
        keyed.append((arc, place, tie, -1 if d is None else d, zlib.crc32(body), len(body) + 1, d))
    for arc, _, _, _, crc, size, d in sorted(keyed, key=lambda k: k[:6]):
        while used[shard := nodes[arc % len(nodes)][1]] == room[shard]:
            arc += 1
        out.append((d, size, crc, shard, used[shard]))
        used[shard] += 1
    return collections.Counter(out)


@pytest.mark.parametrize("range_rows, vnodes", [(1 << 20, 128), (7, 128), (7, 2), (3, 1)])
def test_sharding(spark, docs, rows, range_rows, vnodes, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(sharding, "CELL_BITS", 4)
    more = rows + [(None, "hot")] * 50 + [(i, "hot") for i in range(40)]
    df = spark.createDataFrame(more, SCHEMA).repartition(3).withColumns({"arc": F.lit(1), "n": F.lit("n"), "body": F.lit(0)})
    got = sharding.shard_documents(df, 8, vnodes).collect()
    assert collections.Counter(map(tuple, got)) == ring_walk(more, 8, vnodes)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_one_more_shard_moves_little(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    a, b = ({r.doc_id: r.shard for r in sharding.shard_documents(df, n).collect()} for n in (8, 9))
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.25  # dealing anew moves 8 of 9


def edit(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row), row.index(min(row))


def test_myers():
    rng = random.Random(6)
    for _ in range(1500):
        p, t = ([rng.randrange(4) for _ in range(rng.randrange(lo, hi))] for lo, hi in ((1, 12), (0, 25)))
        assert decontamination.myers(p, t) == edit(p, t)
    p, t = [rng.randrange(9) for _ in range(100)], [rng.randrange(9) for _ in range(300)]
    assert decontamination.myers(p, t) == edit(p, t)


def test_decontamination(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 50)))) for i in range(30)] + [(90, None), (91, "w5 w6"), (92, ""), (93, "w17")] + [(94 + i, " ".join(f"w{17 * i + j}" for j in range(i + 3))) for i in range(5)]
    docs = [(1000, None), (1001, "")]
    for k in range(80):
        w, x = [rng.choice(words) for _ in range(60)], rng.choice(items[:30])[1].split()
        for _ in range(rng.randrange(len(x) // 3)):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = rng.choice([[], ["new"], ["new", "er"]])
        cut = rng.randrange(len(w))
        docs.append((k, " ".join(w[:cut] + [c.upper() + "." for c in x] + w[cut:])))
    docs += docs[:3] + [(None, docs[5][1])]
    want = collections.Counter()
    for d, t in docs:
        for i, it in items:
            p, own = (decontamination.item_words((s or "").encode()) for s in (it, t))
            budget = int(len(p) * decontamination.ERROR_RATE + 1e-9)
            if p and (found := edit(p, own)[0]) <= budget:
                want[d, i, found, budget] += 1
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.matches(df, bench).collect()
    assert collections.Counter((r.doc_id, r.item_id, r.distance, r.budget) for r in got) == want and len(want) > 30
    sizes = {i: len(decontamination.item_words((t or "").encode())) for i, t in items}
    hit = {d for d, i, *_ in want if sizes[i] >= decontamination.EVIDENCE_WORDS}
    assert {i for _, i, *_ in want} > {93} and hit < {d for d, *_ in want}
    clean = decontamination.without_contaminated(df.withColumn("key", F.lit(1)), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in hit) and clean.columns == ["doc_id", "text", "key"]
    blocks = decontamination.BLOCK_WORDS
    try:
        decontamination.BLOCK_WORDS = 100
        assert collections.Counter((r.doc_id, r.item_id, r.distance, r.budget) for r in decontamination.matches(df, bench).collect()) == want
    finally:
        decontamination.BLOCK_WORDS = blocks
    assert decontamination.matches(df, bench.limit(0)).count() == 0 and decontamination.matches(df.limit(0), bench).count() == 0
    assert decontamination.without_contaminated(df, bench.limit(0)).count() == len(docs)


@pytest.mark.parametrize("kind, value", [("short", 3), ("string", "a"), ("double", 1.5), ("date", datetime.date(2020, 1, 1)), ("array<int>", [1, 2])])
def test_items_of_any_type(spark, kind, value):
    bench = spark.createDataFrame([(value, "a b c d e f g h"), (None, "a b c")], f"item_id {kind}, text string").withColumn("doc_id", F.lit(9))
    df = spark.createDataFrame([("x", "z a b c d e f g h", 1)], "doc_id string, text string, item int")
    got = decontamination.matches(df, bench)
    assert got.columns[:2] == ["doc_id", "item_id"]
    assert sorted((r.doc_id, str(r.item_id), r.distance) for r in got.collect()) == sorted([("x", str(value), 0), ("x", "None", 0)])


def test_the_best_of_equal_passages_comes_first(spark):
    df = spark.createDataFrame([(1, "p q r s t u v w x y, k k p q r s t u v w x y")], SCHEMA)
    (r,) = decontamination.matches(df, spark.createDataFrame([(7, "p q r s t u v w x y")], "item_id long, text string")).collect()
    assert (r.distance, r.first_word, r.end_word) == (0, 0, 10)


def test_a_phrase_common_to_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "HITS", 16)
    items = [(i, f"which of the following is the answer to question number {i} here") for i in range(60)]
    df = spark.createDataFrame([(d, " and ".join(t for _, t in items[d::3])) for d in range(3)], SCHEMA)
    got = decontamination.matches(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.where("distance = 0").collect()} == {(i % 3, i) for i, _ in items}


def test_another_benchmark_in_the_same_workers(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "s t u v w x y z")], SCHEMA)
    for i, text in ((1, "a b c d e f g h"), (2, "s t u v w x y z")):
        found = decontamination.matches(df, spark.createDataFrame([(7, text)], "item_id long, text string")).collect()
        assert [(r.doc_id, r.distance) for r in found] == [(i, 0)]


def test_licenses(spark):
    lines = {k: v[0] for k, v in licenses.TEMPLATES.items()}
    long = licenses.TEMPLATES["MIT"][1]
    damaged = " ".join("zz" if i % 9 == 0 else w for i, w in enumerate(long.split()))
    rows = [(i, f"Früher \n{line}\nafter {i}", k) for i, (k, line) in enumerate(lines.items())]
    rows += [(50, f"x {damaged} y", "MIT"), (51, "the license is under the version of this work", None), (52, None, None), (53, "", None), (None, lines["MIT"], "MIT"), (54, (lines["MIT"] + " and ") * 3, "MIT")]
    got = licenses.license_matches(spark.createDataFrame([r[:2] for r in rows], SCHEMA)).collect()
    assert {(r.doc_id, r.license) for r in got} == {(d, k) for d, _, k in rows if k}
    assert sum(r.doc_id == 54 for r in got) == 3
    by = {d: t for d, t, _ in rows}
    for r in got:
        assert r.coverage >= licenses.MIN_COVERAGE
        if r.template == 0 and r.coverage == 1:
            assert by[r.doc_id][r.first_char : r.end_char] == lines[r.license]
    assert licenses.license_matches(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        licenses.Templates({"x": ["word"]})


def test_damaged_licenses_by_brute_force(spark):
    """Recall and precision: whole-text local alignment with every template tells what is to be found."""
    rng = random.Random(5)
    every = licenses.with_tags(licenses.TEMPLATES)
    rows, n = [], 0
    for label, texts in every.items():
        for text in texts:
            w = text.split()
            for share in (0.1, 0.2, 0.2, 0.3):
                damaged = list(w)
                for i in rng.sample(range(len(w)), int(share * len(w))):
                    damaged[i] = f"zz{i}"
                rows.append((n, " ".join(["the", "software", f"x{n}", *damaged, "of", "this"])))
                n += 1
    got = collections.defaultdict(list)
    for r in licenses.license_matches(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        got[r.doc_id].append(r)
    texts = {(k, i): decontamination.item_words(t.encode()) for k, ts in every.items() for i, t in enumerate(ts)}
    wanted = told = 0
    for d, t in rows:
        words = decontamination.item_words(t.encode())
        near = {k: p for k, p in texts.items() if len(set(p) & set(words)) >= 0.6 * len(set(p))}
        shares = {k: licenses.align(p, words, 0, len(words) + len(p))[0] / len(p) for k, p in near.items()}
        best = max(shares.values(), default=0)
        told += len(got[d])
        if best >= licenses.MIN_COVERAGE:
            wanted += 1
            assert max((r.coverage for r in got[d]), default=0) >= best, (d, t, shares)
        else:
            assert not got[d]
        for r in got[d]:
            assert shares[r.license, r.template] >= r.coverage
    assert wanted > 100 and told >= wanted


def test_ties_of_licenses(spark):
    """Of templates that cover the same words the longer one is reported, of equal ones the first."""
    templates = {"b": ["one two three four five six"], "a": ["one two three four five six"], "c": ["one two three four five six seven"]}
    rows = [(1, "x one two three four five six y"), (2, "x one two three four five six seven")]
    got = licenses.license_matches(spark.createDataFrame(rows, SCHEMA).withColumn("license", F.lit(1)), templates).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "b"), (2, "c")]


def test_every_license_text_is_found(spark):
    asked = [
        ("all-rights-reserved", "All rights reserved."),
        ("GPL-2.0", "either version 2"), ("LGPL", "Lesser"), ("AGPL-3.0", "Affero"), ("MPL-2.0", "Mozilla"), ("CC-BY-SA-4.0", "BY-SA"),
        ("CC-BY-ND-4.0", "BY-ND"), ("Unlicense", "unencumbered"), ("MIT", "NONINFRINGEMENT"), ("BSD", "binary form"), ("BSD", "Neither the name"),
    ]
    every = [(k, i, t) for k, ts in licenses.TEMPLATES.items() for i, t in enumerate(ts)]
    assert all(any(k == label and part in t for k, _, t in every) for label, part in asked)
    rows = [(n, f"Some words\n{t}\nand more") for n, (_, _, t) in enumerate(every)]
    got = licenses.license_matches(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.license, r.template) for r in got if r.coverage == 1} >= {(n, k, i) for n, (k, i, _) in enumerate(every)}


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 1 << 30, 6).astype(np.uint64)
        cut = [np.concatenate([rng.integers(0, 1 << 30, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(0, 1 << 30, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(2)]
        kept = [set(h[licenses.winnow(h, np.array([0, len(h)]), 4)].tolist()) for h in cut]
        assert kept[0] & kept[1] & set(shared.tolist())


def test_alignment():
    assert licenses.align([1, 2, 3, 4], [9, 1, 2, 3, 4, 9], 1, 2) == (4, 1, 5)
    assert licenses.align([1, 2, 3, 4, 5], [1, 2, 7, 4, 5], 0, 2) == (4, 0, 5)
    assert licenses.align([1, 2, 3, 4, 5], [1, 2, 3, 8, 4, 5], 0, 2) == (5, 0, 6)
