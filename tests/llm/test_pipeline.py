"""The pipeline's stages against brute force on a small corpus."""

import base64
import collections
import random
import re

import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from portolan.llm import near_dedup, simhash, stages
from portolan.llm.decontamination import item_words
from test_corpus_statistics import fences, measures
from test_duplicates import edit, roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    items = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(6)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 120))) for _ in range(120)]
    texts += texts[:10]
    for i in range(10, 25):  # near copies: one word in sixty
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [f"{texts[30]} mail{i}@x.com and more {texts[31 + i]}" for i in range(5)]
    texts += [f"{texts[40 + i]} {items[i % 6][1]} {texts[50 + i]}" for i in range(8)]
    texts += ["short", "", None, "again and again " * 30, texts[3]]
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", len(t or ""), "x", None) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[6], "en", "s", 1, "x", None)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def plain(rows):
    return collections.Counter((r[0], r[1]) for r in rows)


def shingles(text):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def wide(text):
    found = shingles(text)
    ones = collections.Counter(b for s in found for h in [xxhash.xxh128_intdigest(s, 42)] for b in range(128) if h >> b & 1)
    return sum(1 << b for b in range(128) if 2 * ones[b] > len(found))


def test_stages(spark, corpus):
    folder, rows, items = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    # quality rules
    want = [r for r, k in zip(rows, fences([(r[0], r[1], r[2], r[3]) for r in rows], [measures(r[1]) for r in rows])) if k]
    docs = corpus_pipeline.STAGES[0][1](spark, docs, folder)
    assert plain(docs.select("doc_id", "text").collect()) == plain(want) and docs.columns == columns
    # near-dedup
    prints = [wide(r[1]) for r in want]
    alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    links = [(i, j) for i in range(len(want)) for j in range(i) if alike(want[i][1], want[j][1]) >= near_dedup.SIMILARITY]
    assert all((prints[i] ^ prints[j]).bit_count() <= near_dedup.RADIUS for i, j in links)
    root = roots(len(want), links)
    groups = collections.defaultdict(list)
    for r, k in zip(want, root):
        groups[k].append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    docs = corpus_pipeline.STAGES[1][1](spark, docs, folder)
    assert plain(docs.select("doc_id", "text").collect()) == plain(want) and docs.columns == columns
    ids = {r[0] for r in want}
    near = {130 + i for i in range(15) if alike(rows[130 + i][1], rows[10 + i][1]) >= near_dedup.SIMILARITY}
    assert near and not ids & {*range(120, 130), *near} and {*range(60, 100)} <= ids  # copies and near copies go, others stay
    # decontamination
    budget = int(25 * 0.2)
    want = [r for r in want if all(edit(item_words(t.encode()), item_words(r[1].encode()))[0] > budget for _, t in items)]
    docs = corpus_pipeline.STAGES[2][1](spark, docs, folder)
    assert plain(docs.select("doc_id", "text").collect()) == plain(want) and docs.columns == columns
    # personal data
    want = [(r[0], re.sub(r"mail\d@x\.com", "<EMAIL>", r[1])) for r in want]
    docs = corpus_pipeline.STAGES[3][1](spark, docs, folder)
    assert plain(docs.select("doc_id", "text").collect()) == plain(want) and docs.columns == columns
    assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    # encoding
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ends = sorted((str(d), own.encode_ordinary(t)) for d, t in want)
    assert sorted((str(r.doc_id), list(r.ids)) for r in corpus_pipeline.STAGES[4][1](spark, docs, folder).collect()) == ends
    assert sorted((str(r.doc_id), list(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) == ends


def test_pipeline_of_nothing(spark, corpus, tmp_path):
    folder, *_ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("group", [2048, 16])
def test_near_dedup_of_families(spark, group, monkeypatch):
    """False links between variants of a text hide no true one, in one place or over many blocks."""
    monkeypatch.setattr(simhash, "TILE", 64)
    monkeypatch.setattr(simhash, "STRIP", 32)
    monkeypatch.setattr(near_dedup, "GROUP", group)
    rng = random.Random(2)
    texts = []
    for f in range(3):
        base = [f"f{f}w{rng.randrange(900)}" for _ in range(200)]
        for v in range(80):
            w = list(base)
            for e in range(rng.randrange(9)):
                w[rng.randrange(200)] = f"e{v}x{e}"
            texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    prints, sets = [wide(t) for t in texts], [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= near_dedup.RADIUS]
    links = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= near_dedup.SIMILARITY * len(sets[i] | sets[j])]
    assert len(near) > 2 * len(links) > 0
    want = {i for i, k in enumerate(roots(len(texts), links)) if i == k}
    rows = [(i, t, "en", "s", len(t), "x", None) for i, t in enumerate(texts)]
    got = stages.one_of_each(spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(3)).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_near_dedup_of_odd_rows(spark):
    """Ids of any type, nulls, empty texts, repeated rows and clashing columns."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("b", base, "x"), ("a", base + " more", "y"), (None, base, "z"), ("a", base + " more", "y"), ("c", "", "n"), ("d", None, "n"), ("e", "few words", "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, node string").withColumns({"k1": F.lit(1), "hit": F.lit("h"), "row": F.lit("r")})
    got = near_dedup.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("a", base + " more"), ("c", ""), ("e", "few words")]
    assert near_dedup.one_of_each(docs.limit(0)).count() == 0


def test_size_classes_are_exact():
    bounds = near_dedup.size_classes(0.8, 5000)
    for m, n in ((m, n) for m in range(1, 300) for n in range(m, 400)):
        if 5 * m >= 4 * n:
            a, b = (sum(x <= v for x in bounds) for v in (m, n))
            assert b - a <= 1
