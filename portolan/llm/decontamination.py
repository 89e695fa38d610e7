"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may differ from a passage by a budget of n * ERROR_RATE word edits. Cut into budget + 1 pieces, at
least one piece of it stands unchanged in any such passage. Pieces' names are looked up at every place of every text;
around each hit, Myers' bit-parallel distance, with words as symbols, tells whether the item ends within its budget,
and where. Words are lower-cased (A-Z) and stripped of the ASCII punctuation at their ends.

Items reach the workers in blocks of BLOCK_WORDS words at most, each a pass over the texts, so that what is broadcast
is bounded whatever the benchmark's size; each pass but the last is written before the next block is made. Texts never
leave their partition.

Defined results: null or empty texts and items match nothing; items of any length are matched, those of few words with
the budget that is theirs (none below five words), but rows are removed for items of EVIDENCE_WORDS words at least, since
shorter ones are in clean texts too; equal items are matched once each; of passages with equal distance the first is
reported; ids are of any type; null ids and repeated rows are rows like any other; the columns of the texts are returned
as they are, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, CACHE_LENGTH, Scratch, byte_texts, slices, table

ERROR_RATE = 0.2
#: The least words of an item for which rows are removed, by default.
EVIDENCE_WORDS = 8
BLOCK_WORDS = 1 << 20
#: Piece hits that are held at once, about.
HITS = 1 << 18
#: ASCII punctuation, as string.punctuation has it.
EDGES = rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def item_words(text: bytes) -> list[bytes]:
    """The words of a text; those that are punctuation only count as empty words."""
    return [w.strip(EDGES) for w in text.lower().split()]


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """(from, to) of budget + 1 pieces of n words, of sizes that differ by one at most."""
    cuts = [n * i // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts, cuts[1:]))


def myers(pattern: list, text: list) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a part of text that ends before `end`, the first such end.

    Bit-parallel: bit i of the vertical deltas is row i of the column; Python's integers hold any length.
    """
    m = len(pattern)
    where: dict = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    every, top = (1 << m) - 1, 1 << m - 1
    up, down, score = every, 0, m
    best, end = m, 0
    for j, x in enumerate(text, 1):
        eq = where.get(x, 0)
        d0 = ((eq & up) + up ^ up | eq | down) & every
        hp = down | ~(d0 | up) & every
        hn = up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & every
        hn = hn << 1 & every
        up = hn | ~(d0 | hp) & every
        down = hp & d0
        if score < best:
            best, end = score, j
    return best, end


class Index:
    """A block of items: words numbered from 1, pieces' names sorted by length."""

    def __init__(self, items: list[tuple[int, list[bytes]]], error_rate: float):
        import numpy as np

        from .substrings import span_names

        self.ids, self.hits = [i for i, _ in items], HITS
        self.words: dict[bytes, int] = {}
        self.items = [[self.words.setdefault(w, len(self.words) + 1) for w in ws] for _, ws in items]
        self.budgets = [int(len(ws) * error_rate + 1e-9) for _, ws in items]
        by_size: dict[int, list] = {}
        for k, (item, budget) in enumerate(zip(self.items, self.budgets)):
            x = np.array(item, dtype=np.uint64)
            for a, b in pieces(len(item), budget):
                by_size.setdefault(b - a, []).append((int(span_names(x, np.array([a]), np.array([b]), BASE)[0]), k, a))
        self.pieces = {}
        for size, found in by_size.items():
            found.sort()
            names, which, offset = zip(*found)
            self.pieces[size] = (np.array(names, dtype=np.uint64), np.array(which), np.array(offset))

    def candidates(self, x, bounds, text):
        """Arrays of (item, text, diagonal), sorted, of the piece hits in the concatenated word numbers x, some `hits` at a time."""
        import numpy as np

        from .substrings import span_names

        n = len(x)
        ends = np.append(bounds, n)
        known = np.concatenate([[0], np.cumsum(x == 0)])
        for size, (names, which, offset) in self.pieces.items():
            if n < size:
                continue
            at = np.nonzero(known[size:] == known[: n + 1 - size])[0]  # all words are the benchmark's
            at = at[at + size <= ends[np.searchsorted(bounds, at, side="right")]]
            own = span_names(x, at, at + size, BASE)
            lo, hi = np.searchsorted(names, own, side="left"), np.searchsorted(names, own, side="right")
            hit = np.nonzero(hi > lo)[0]
            many = hi[hit] - lo[hit]
            upto = np.cumsum(many)
            for part in np.split(np.arange(len(hit)), np.nonzero(np.diff(upto // self.hits))[0] + 1):
                if len(part):
                    m = many[part]
                    entry = np.repeat(lo[hit[part]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    place = np.repeat(at[hit[part]], m)
                    yield np.unique(np.stack([which[entry], text[place], place - offset[entry]], axis=1), axis=0)

    def matches(self, x, bounds, begins, sizes, text):
        """(text, item, distance, first word, end word) of the best passage of each item near each hit, one an item and text."""
        found: dict = {}
        words = x.tolist()
        for part in self.candidates(x, bounds, text):
            reach = (-1, -1, -1)
            for k, t, diagonal in part.tolist():
                item, budget = self.items[k], self.budgets[k]
                if (k, t) == reach[:2] and diagonal <= reach[2]:
                    continue  # the last window held it
                best = found.get((t, k), (budget + 1, 0))
                if best[0] == 0 and best[1] <= diagonal - int(begins[t]):
                    continue  # an exact passage that comes first is the best
                begin, end = int(begins[t]), int(begins[t] + sizes[t])
                a, b = max(begin, diagonal - 2 * budget), min(end, diagonal + len(item) + 2 * budget)
                distance, stop = myers(item, words[a:b])
                reach = (k, t, diagonal + budget)
                if distance <= budget:
                    _, back = myers(item[::-1], words[a : a + stop][::-1])
                    own = (distance, a + stop - back - begin, a + stop - begin)
                    if own < best:
                        found[t, k] = own
        return [(t, k, *v) for (t, k), v in found.items()]


BASE = 0x9E3779B97F4A7C15
_NUMBERS: dict = {}


class Numbers(dict):
    """Raw word to its number in an index, 0 if it isn't there."""

    def __init__(self, words: dict[bytes, int]):
        self.words = words

    def __missing__(self, word: bytes) -> int:
        n = self.words.get(word.strip(EDGES), 0)
        if len(word) <= CACHE_LENGTH:
            self[word] = n
        return n


def blocks(benchmark: DataFrame, text: str, least: int):
    """Lists of (number, words) of the items with `least` words at least, each list of BLOCK_WORDS words at most, one item at
    least; benchmark has each item's number."""
    held, size = [], 0
    for row in benchmark.select("number", F.col(text).alias("t")).toLocalIterator():
        words = item_words((row["t"] or "").encode())
        if len(words) < max(least, 1):
            continue
        if held and size + len(words) > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append((row["number"], words))
        size += len(words)
    if held:
        yield held


def numbered(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(number, item, text): each row's number, written, so that a number stays a row's."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("number"), F.col(item).alias("item"), F.col(text).alias("text"))
    return Scratch(benchmark.sparkSession).keep(rows, "items")


def _found(part, index: Index):
    import numpy as np

    if _NUMBERS.get("of") is not index or len(_NUMBERS["numbers"]) > CACHE_ENTRIES:
        _NUMBERS.update(of=index, numbers=Numbers(index.words))
    words = [x.lower().split() for x in byte_texts(part)]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    flat = [w for ws in words for w in ws]
    x = np.fromiter(map(_NUMBERS["numbers"].__getitem__, flat), dtype=np.uint64, count=len(flat))
    return index.matches(x, begins[sizes > 0], begins, sizes, np.repeat(np.arange(len(sizes)), sizes))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE) -> DataFrame:
    """(key, item, distance, budget, first_word, end_word): the best passage of each text for each item within its budget."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    names = ["key", "number", "distance", "budget", "first_word", "end_word"]
    schema = f"key {rows.schema['key'].dataType.simpleString()}, number long, distance int, budget int, first_word int, end_word int"
    items = numbered(benchmark, item, item_text)
    out, last = [], None
    for block in blocks(items, "text", 1):
        if last is not None:
            out.append(_written(spark, *last))
        told = spark.sparkContext.broadcast(Index(block, error_rate))

        def batches(parts, told=told):
            import pyarrow as pa

            for batch in parts:
                for part in slices(batch):
                    index = told.value
                    found = sorted(_found(part, index))
                    if found:
                        t, k, *rest = zip(*found)
                        numbers = [pa.array(v, pa.int32()) for v in (rest[0], [index.budgets[i] for i in k], *rest[1:])]
                        yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(t)), pa.array([index.ids[i] for i in k], pa.int64()), *numbers], names=names)

        last = (rows.mapInArrow(batches, schema), told)
    found = spark.createDataFrame([], schema) if last is None else reduce(DataFrame.unionAll, [*out, last[0]])
    found = found.join(items.select("number", "item"), "number")
    return found.select(F.col("key").alias(key), F.col("item").alias(item), *names[2:])


def _written(spark, found: DataFrame, told) -> DataFrame:
    """found, written; its broadcast goes."""
    out = Scratch(spark).keep(found, "found")
    told.destroy()
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", error_rate: float = ERROR_RATE, least: int = EVIDENCE_WORDS) -> DataFrame:
    """The rows of docs in which no item of `least` words or more matches, with all their columns."""
    spark = docs.sparkSession
    out, last = docs, None
    items = benchmark.select(F.lit(0).alias("number"), F.col(item_text).alias("text"))
    for block in blocks(items, "text", least):
        if last is not None:
            out = _written(spark, out, last)
        last = spark.sparkContext.broadcast(Index(block, error_rate))

        def batches(parts, told=last):
            import numpy as np
            import pyarrow as pa

            for batch in parts:
                for part in slices(batch, text):
                    index = told.value
                    clean = np.ones(part.num_rows, dtype=bool)
                    one = pa.RecordBatch.from_arrays([part.column(text)], names=["text"])
                    clean[[m[0] for m in _found(one, index)]] = False
                    yield part.filter(pa.array(clean))

        out = out.mapInArrow(batches, docs.schema)
    return out


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "budget", "first_word", "end_word")
