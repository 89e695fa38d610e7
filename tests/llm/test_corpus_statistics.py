"""Quality rules, language model, token counts and byte-level BPE against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from portolan.llm import byte_bpe, language_model, quality_rules, token_counts

DOCS = "doc_id long, text string, lang string, source string"
EDGES = [None, "", " \t\n", "a", "é\x85 ñ\xa0b", "x" * 200_000, "w " * 30_000, "one two\n\n\nthree", "<|endoftext|>", "a<|endoftext|> b"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ".", "\n", "##"]) for _ in range(rng.randrange(0, 120))) for _ in range(n)]
    texts += ["same line\n" * 30, "spam ham eggs jam toast milk tea cake " * 8, "# $ % & " * 20]
    texts += EDGES
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None])) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    out = corpus()
    return out + out[:5] + [(None, "a b c d e", None, None), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_measures(docs, rows):
    got = quality_rules.measure(docs).select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[2:]) == measures(r.text)


def fences(rows, passed):
    """Thresholds by plain sorting."""
    def bucket(v):
        cut = max(v.bit_length() - quality_rules.PRECISION_BITS, 0)
        return v >> cut << cut

    def values(m):
        n, chars, symbols, dups, repeats, _ = m
        return {"symbols": 1000 * symbols // max(chars, 1), "dup_lines": 1000 * dups // max(n, 1), "repeats": 1000 * repeats // max(n, 1), "word_length": 100 * chars // max(n, 1)}

    by = collections.defaultdict(list)
    for (_, _, lang, source), m in zip(rows, passed):
        if not m[-1]:
            for key in ((lang, source), (lang,), ()):
                by[key].append(m)
    out = []
    for (_, _, lang, source), m in zip(rows, passed):
        group = next((by[k] for k in ((lang, source), (lang,), ()) if len(by[k]) >= quality_rules.MIN_ROWS), by[()])
        kept = not m[-1]
        for name, (slack, low) in quality_rules.MEASURES.items():
            every = sorted(bucket(values(x)[name]) for x in group) or [0]
            q = lambda p: every[-(-p * len(every) // 100) - 1]
            spread = quality_rules.SPREAD * (q(75) - q(25))
            kept = kept and values(m)[name] <= q(75) + spread + slack and (not low or values(m)[name] >= q(25) - spread - slack)
        out.append(kept)
    return out


@pytest.mark.parametrize("least", [1, 20, 100, 10_000])
def test_thresholds(docs, rows, least, monkeypatch):
    monkeypatch.setattr(quality_rules, "MIN_ROWS", least)
    passed = [measures(r[1]) for r in rows]
    want = collections.Counter((r[0], r[1], k) for r, k in zip(rows, fences(rows, passed)))
    got = collections.Counter((r.row.doc_id, r.row.text, r.kept) for r in quality_rules.quality_rules(docs).select("row", "kept").collect())
    assert got == want


@pytest.mark.parametrize("salt_rows", [1 << 20, 7])
def test_thresholds_of_many_groups(docs, rows, salt_rows, monkeypatch):
    """Beyond the groups that are broadcast, both sides shuffle, large groups over several keys."""
    monkeypatch.setattr(quality_rules, "MIN_ROWS", 20)
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(quality_rules, "SALT_ROWS", salt_rows)
    want = collections.Counter((r[0], r[1], k) for r, k in zip(rows, fences(rows, [measures(r[1]) for r in rows])))
    judged = quality_rules.quality_rules(docs)
    assert collections.Counter((r.row.doc_id, r.row.text, r.kept) for r in judged.select("row", "kept").collect()) == want


def test_quality_rules_are_native(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_quality_of_nothing_and_clashing_names(spark, docs):
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
    odd = docs.select("*", F.lit(1).alias("row"), F.lit(2).alias("h"), F.lit(3).alias("kept"), F.lit(4).alias("w")).limit(40)
    got = quality_rules.quality_rules(odd)
    assert got.count() == 40 and got.select("row.kept").distinct().count() == 1


def test_sketches_merge(docs):
    measured = quality_rules.measure(docs)
    whole = quality_rules.sketch(measured, F.col("row.lang"), F.col("row.source"))
    halves = [quality_rules.sketch(measured.where(F.coalesce(F.col("row.doc_id"), F.lit(0)) % 2 == k), F.col("row.lang"), F.col("row.source")) for k in (0, 1)]
    keys = ["lang", "source"]
    merged = quality_rules.merge(halves[0].unionAll(halves[1]), keys)
    assert sorted(map(str, merged.select(*keys, "measure", "bucket", "n").collect())) == sorted(map(str, whole.select(*keys, "measure", "bucket", "n").collect()))


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows, tokenizer):
    path = P.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(docs, path, P.PATTERN, decode=True)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(coded).collect())
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    back = byte_bpe.decode(coded.select("doc_id", "ids"), path, P.PATTERN).collect()
    assert collections.Counter((r.doc_id, bytes(r.decoded)) for r in back) == collections.Counter((r[0], (r[1] or "").encode()) for r in rows)


def test_byte_bpe_of_nothing_and_clashing_names(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.encode(docs.limit(0), path, P.PATTERN, decode=True).count() == 0
    odd = spark.createDataFrame([("a", "x y", 1, "z")], "doc_id string, text string, key int, ids string")
    assert [tuple(r)[0] for r in byte_bpe.encode(odd, path, P.PATTERN).collect()] == ["a"]
    assert token_counts.token_counts(odd, P.path("byte_bpe_50k.json"), P.PATTERN).first()["n_tokens"] == 2


def test_byte_bpe_round_trip_of_random_texts(tokenizer):
    rng = random.Random(4)
    codec = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0xA0, 0x3000), rng.randrange(0x1F300, 0x1F600), 32, 10, 39])) for _ in range(rng.randrange(60)))
        assert codec.encode([text]) == [tokenizer.encode_ordinary(text)]
        assert codec.decode(codec.encode([text])[0]).decode() == text


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = collections.Counter((d, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows)
    got = token_counts.token_counts(docs, path, P.PATTERN)
    assert collections.Counter(map(tuple, got.collect())) == want
    assert token_counts.token_counts(docs.limit(0), path, P.PATTERN).count() == 0


def test_language_model(docs, rows):
    got = language_model.language_model_scores(docs).collect()
    tokens = [((t or "").encode().lower().split() + [b"\n"], zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1, d) for d, t, *_ in rows]
    counts = collections.Counter(w for ws, held, _ in tokens if not held for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(d), held, len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)) for ws, held, d in tokens)
    mine = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(mine, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_learns(spark):
    rng = random.Random(2)
    follows = {a: [rng.choice("abcdefghij") for _ in range(2)] for a in "abcdefghij"}
    texts = []
    for i in range(600):
        w = [rng.choice("abcdefghij")]
        while len(w) < 60:
            w.append(rng.choice(follows[w[-1]]))
        texts.append((i, " ".join(w)))
    got = language_model.language_model_scores(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.2  # of log10(10) - log10(2), about 0.7


def plain_tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def plain_name(token):
    import xxhash

    last = token.rstrip(b".,;:!?")[-1:] or b"@"
    return xxhash.xxh64_intdigest(token, 11) // 64 * 64 + last[0] % 32 + 32 * (not token.isascii())


@pytest.mark.parametrize("words, members, learner_tokens", [(16_384, 128, 1 << 22), (40, 8, 500), (5, 2, 100)])
def test_language_model_scores_by_brute_force(spark, words, members, learner_tokens, monkeypatch):
    """Token by token with the trained model's numbers; the same from other partitions; and all tokens' chances sum to 1."""
    import numpy as np

    lm = language_model
    monkeypatch.setattr(lm, "WORDS", words)
    monkeypatch.setattr(lm, "MEMBERS", members)
    monkeypatch.setattr(lm, "LEARNER_TOKENS", learner_tokens)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    rng = random.Random(3)
    known = [f"{rng.choice('abcdé')}{i}{rng.choice('xyz.')}" for i in range(90)]
    rows = [(i, " ".join(known[min(int(rng.expovariate(0.08)), 89)] for _ in range(rng.randrange(40)))) for i in range(150)] + [(None, None), (200, ""), (201, "Never seen"), (3, "A a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {}
    plain_train = lm.train

    def train(prepared, stats):
        kept.update(stats=stats, model=plain_train(prepared, stats))
        return kept["model"]

    monkeypatch.setattr(lm, "train", train)
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.language_model_scores(df.repartition(3).withColumn("key", F.lit(1))).collect())
    again = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.language_model_scores(df.repartition(5)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in again] and np.allclose([x[2] for x in got], [x[2] for x in again], rtol=1e-4)
    stats, m = kept["stats"], kept["model"]
    counts = collections.Counter(t for d, x in rows if zlib.crc32(str(d).encode() if d is not None else b"") % 5 != 1 for t in plain_tokens(x))
    ranked = sorted(counts, key=lambda t: (-counts[t], plain_name(t)))
    number = {t: i for i, t in enumerate(ranked[:words])} if len(ranked) > words else {t: i for i, t in enumerate(ranked)}
    forms = collections.defaultdict(list)
    for t in ranked[words:]:
        forms[plain_name(t) % 64].append(counts[t])
    symbol = lambda t: 64 + number[t] if t in number else plain_name(t) % 64
    whole = lambda f: sum(forms[f]) + 0.5 * (len(forms[f]) + 1)

    def softmax(scores):
        e = np.exp(scores - scores.max())
        return e / e.sum()

    def chance(before, token):
        s = symbol(token)
        h = sum(m.position[i].astype(float) * m.left[c] for i, c in enumerate(before))
        classes = softmax(m.right.astype(float) @ h + m.bias)
        if s < 64:
            return classes[s] * (counts[token] + 0.5) / whole(s)
        c = (s - 64) // members
        own = softmax(m.word_right[c * members : (c + 1) * members].astype(float) @ h + m.word_bias[c * members : (c + 1) * members])
        return classes[64 + c] * own[(s - 64) % members]

    none = len(stats.weights)
    want = []
    for d, x in rows:
        tokens = plain_tokens(x)
        ids = [none, none, *map(symbol, tokens)]
        want.append((str(d), len(tokens), sum(math.log10(chance((ids[i + 1], ids[i]), t)) for i, t in enumerate(tokens))))
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], rtol=1e-4)
    for before in ((none, none), (64, none), (64, 3)):
        unseen = sum(0.5 / whole(f) * softmax(m.right.astype(float) @ sum(m.position[i].astype(float) * m.left[c] for i, c in enumerate(before)) + m.bias)[f] for f in range(64))
        assert sum(chance(before, t) for t in counts) + unseen == pytest.approx(1, abs=1e-5)


def test_language_model_of_nothing(spark):
    assert language_model.language_model_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3], "doc_id long, text string")
    assert {(r.n_known, r.train_tokens) for r in language_model.language_model_scores(held).collect()} == {(0, 0)}
