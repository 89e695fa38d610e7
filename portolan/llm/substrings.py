"""Substring dedup by recompression.

A round of recompression names the maximal runs of equal tokens, then the adjacent pairs whose left symbol is of the
left class and whose right symbol is of the right class (a bit of the symbol's name tells). Names are keyed hashes of
what they stand for, so every worker gives a run or pair the same name without a dictionary, and equal substrings get
equal interior symbols. A symbol's support is the stretch of text that proves it: the symbol and the neighbours that
decided its run and its pairing. A symbol whose support lies inside a window is there wherever the window's words are.

The next round does the same with the symbols that this one leaves. The wider the window, the more rounds leave symbols
that it supports: one for 13 words, two from 32, three from 64.

Phrases, the shortest sequences of the last round's symbols with PHRASE words at least, are named one level higher. The phrase of least
name among those supported inside a window is the window's anchor; equal windows have equal anchors.
Round 1 (Spark): anchors are dealt by name, and those that two rows share are told to all by a bitmap of fixed size,
each bucket of names making its own stretch of it; a false hit costs a window sent in vain.
Round 2 (Spark): windows with a shared anchor, and the few without any anchor, are dealt by a 96-bit name made of the
symbols that stand inside them and of the words at their edges that no such symbol covers; the least doc_id of each is
found, and windows with a smaller one than their own are sent back. A slice asks once for a window that it repeats, so a
hot one meets its bucket once a slice.
Round 3: the words that such windows cover are removed.
Names travel packed, a row for each slice of texts and bucket.

Defined results: a null text has no words; a null doc_id counts as larger than any other; ids are whole numbers below
2**63 - 1, others are refused; rows with the same doc_id and text have the same result and repeated rows return as often as
they occur; other columns, whatever their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, CACHE_LENGTH, byte_texts, slices, table
from .packed import bucket_count, by_bucket, pack, read_rows, runs

WINDOW = 13
PHRASE = 5
NO_ID = (1 << 63) - 1

#: Bits of the broadcast bitmap of shared anchors: 16 MB.
FILTER_BITS = 1 << 27
#: Names that a bucket takes in before it drops those that came three times.
MERGE_NAMES = 1 << 20

#: Stands for a row's number where a slice asks for a window that it repeats; a slice has fewer rows.
REPEATED = (1 << 16) - 1

_NAMES: dict = {}


class Names(dict):
    def __missing__(self, token: bytes) -> int:
        from xxhash import xxh64_intdigest

        name = xxh64_intdigest(token, 7)
        if len(token) <= CACHE_LENGTH:
            self[token] = name
        return name


def token_names(tokens: list[bytes]):
    import numpy as np

    names = _NAMES.setdefault("tokens", Names())
    if len(names) > CACHE_ENTRIES:
        names.clear()
    return np.fromiter(map(names.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x):
    """A 64-bit finaliser (the public splitmix64) of an array."""
    import numpy as np

    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def powers(base: int, n: int):
    """base**i and base**-i modulo 2**64 for i < n."""
    import numpy as np

    found = _NAMES.get(base)
    if found is None or len(found[0]) < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        found = _NAMES[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return found[0][:n], found[1][:n]


def span_names(x, first, last, base: int):
    """Names of x[first..last-1] for arrays of bounds: equal for equal sequences wherever they stand."""
    import numpy as np

    up, down = powers(base, len(x) + 1)
    total = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * up[: len(x)], out=total[1:])
    return mix((total[last] - total[first]) * down[first])


class Symbols:
    """Symbols of the concatenated texts in order: name, words start..end-1, support left..right-1, and text.

    A support that needs what lies beyond its text reaches one place beyond the text.
    """

    def __init__(self, name, start, end, left, right, text):
        self.name, self.start, self.end, self.left, self.right, self.text = name, start, end, left, right, text


def tokens_as_symbols(x, bounds) -> Symbols:
    import numpy as np

    at = np.arange(len(x))
    return Symbols(x, at, at + 1, at, at + 1, np.searchsorted(bounds, at, side="right"))


def next_round(symbols: Symbols, number: int) -> Symbols:
    """One round of recompression: runs of equal symbols get names, then pairs of a left and a right one."""
    import numpy as np

    n = len(symbols.name)
    new = np.ones(n, dtype=bool)
    new[1:] = (symbols.name[1:] != symbols.name[:-1]) | (symbols.text[1:] != symbols.text[:-1])
    at = np.nonzero(new)[0]
    to = np.append(at[1:], n) - 1
    k = (to - at + 1).astype(np.uint64)
    start, end, text = symbols.start[at], symbols.end[to], symbols.text[at]
    name = np.where(k == 1, symbols.name[at], mix(mix(symbols.name[at]) + k))
    first, last = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)  # of their texts
    first[1:] = last[:-1] = text[1:] != text[:-1]
    # the neighbours tell that a run ends
    left = np.where(first, start - 1, np.append(0, symbols.left[to[:-1]]))
    right = np.where(last, end + 1, np.append(symbols.right[at[1:]], 0))
    salt = np.uint64((0xA5A5A5A5A5A5A5A5 * (2 * number + 1)) % (1 << 64))
    is_left = (mix(name ^ salt) >> np.uint64(63)).astype(bool)
    pair, second = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    pair[:-1] = is_left[:-1] & ~is_left[1:] & ~last[:-1]
    second[1:] = pair[:-1]
    # a single's class tells which neighbour might have paired with it
    alone = ~pair & ~second
    after, before = np.append(right[1:], 0), np.append(0, left[:-1])
    right = np.where(alone & is_left & ~last, after, right)
    left = np.where(alone & ~is_left & ~first, before, left)
    own = np.nonzero(~second)[0]
    other = own + pair[own]
    name = np.where(pair[own], mix(mix(name[own]) ^ (name[other] * np.uint64(3))), name[own])
    return Symbols(name, start[own], end[other], left[own], right[other], text[own])


def rounds_for(window: int) -> int:
    """Rounds whose symbols still have their supports inside a window: one more for each doubling beyond 16 words."""
    return max(1, (window // 8).bit_length() - 1)


def recompressed(x, bounds, window: int = WINDOW, rounds: int | None = None) -> Symbols:
    """The symbols that the rounds for this window leave of the tokens' names x; bounds: where the texts begin."""
    symbols = tokens_as_symbols(x, bounds)
    for number in range(rounds or rounds_for(window)):
        symbols = next_round(symbols, number)
    return symbols


def window_names(x, symbols: Symbols, at, window: int):
    """Two 64-bit names of the windows at the tokens `at`: of the symbols whose supports lie inside, of the words before the
    first and after the last of them, and of how many words these are. Equal windows have equal parts."""
    import numpy as np

    lo = np.searchsorted(symbols.left, at)  # supports begin and end in the symbols' order
    hi = np.maximum(lo, np.searchsorted(symbols.right, at + window, side="right"))
    some, end = hi > lo, at + window
    inner, outer = symbols.start[np.minimum(lo, len(symbols.start) - 1)], symbols.end[np.maximum(hi, 1) - 1]
    inner, outer = np.where(some, inner, end), np.where(some, outer, end)
    sizes = (inner - at).astype(np.uint64) << np.uint64(32) | (end - outer).astype(np.uint64)
    out = []
    for base, salt in ((0xD1342543DE82EF95, 0), (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)):
        words, own = (mix(v ^ np.uint64(salt)) if salt else v for v in (x, symbols.name))
        parts = (span_names(words, at, inner, base), span_names(own, lo, hi, base), span_names(words, outer, end, base))
        out.append(mix(mix(mix(parts[0] ^ sizes) + parts[1]) ^ parts[2]))
    return out


def anchors(x, bounds, window: int = WINDOW, phrase: int | None = None, rounds: int | None = None, symbols: Symbols | None = None):
    """(anchor, has, whole) for the window that starts at each token: its anchor's name, whether it has one, and whether the
    window fits into its text. Windows of the same tokens have the same anchor or none."""
    import numpy as np

    n = len(x)
    phrase = phrase or max(1, window * PHRASE // WINDOW)
    symbols = symbols or recompressed(x, bounds, window, rounds)
    name, s, e, left, right = symbols.name, symbols.start, symbols.end, symbols.left, symbols.right
    last = np.searchsorted(e, s + phrase)  # the symbol that makes the phrase long enough
    text_end = np.append(bounds, n)[symbols.text]
    fits = (last < len(e)) & (e[np.minimum(last, len(e) - 1)] <= text_end)
    last = np.minimum(last, len(e) - 1)
    own = span_names(name, np.arange(len(name)), last + 1, 0x9E3779B97F4A7C15)
    reach = np.where(fits, right[last], text_end + 1)
    least = [own]
    while 1 << len(least) <= window:
        half = 1 << (len(least) - 1)
        low = least[-1].copy()
        low[:-half] = np.minimum(low[:-half], least[-1][half:])
        least.append(low)
    least = np.stack(least)
    # candidates of the window at i: the phrases from lo, whose supports start in it, to before hi, whose end in it
    i = np.arange(n)
    lo = np.cumsum(np.bincount(left + 1, minlength=n + 2))[i]
    hi = np.cumsum(np.bincount(reach, minlength=n + window + 1))[i + window]
    width = hi - lo
    whole = i + window <= np.append(bounds, n)[np.searchsorted(bounds, i, side="right")]
    has = whole & (width > 0)
    level = np.zeros(n, dtype=np.int64)
    level[has] = np.log2(width[has]).astype(np.int64)
    a = least[level[has], lo[has]]
    b = least[level[has], hi[has] - (1 << level[has])]
    out = np.zeros(n, dtype=np.uint64)
    out[has] = np.minimum(a, b)
    return out, has, whole


def _slice_rows(part):
    """Token names, text bounds, text of each token and the slice's row keys (n x 2 longs); None without any word."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = [x.split() for x in byte_texts(part)]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    keys = np.stack([part.column("k1").to_numpy(), part.column("k2").to_numpy()], axis=1).astype("<i8")
    slice_id = xxh64_intdigest(keys.tobytes()) // 2
    if not sizes.sum():
        return None
    ends = np.cumsum(sizes)
    x = token_names([w for ws in words for w in ws])
    text = np.repeat(np.arange(len(words)), sizes)
    return x, (ends - sizes)[sizes > 0], text, ends - sizes, keys, slice_id


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, k1, k2, text): the row's identity is its id and its text's hash, whatever order rows come in."""
    if docs.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{key} must be a column of whole numbers")
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(t).alias("k2"), t.alias("text"))


def _send_anchors(batches, buckets: int, window: int, bits: int):
    import numpy as np

    for batch in batches:
        for part in slices(batch):
            got = _slice_rows(part)
            if got is None:
                continue
            x, bounds, text, _, keys, slice_id = got
            name, has, _ = anchors(x, bounds, window)
            name, text = name[has] >> np.uint64(16), text[has]
            new = np.ones(len(name), dtype=bool)
            new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
            name, text = name[new], text[new]
            order = np.lexsort((text, name))
            name, text = name[order], text[order]
            new = np.ones(len(name), dtype=bool)
            new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
            name, text = name[new], text[new]
            # once a name for a text, and no more than twice for a slice: two rows are enough
            times = np.arange(len(name)) - np.searchsorted(name, name)
            name = name[times < 2]
            yield from by_bucket(name % np.uint64(bits) // np.uint64(bits // buckets), buckets, slice_id, high=(name >> np.uint64(16)).astype("<u4"), low=name.astype("<u2"))


def _find_shared(batches, buckets: int, bits: int, most: int):
    """(bucket, bits): the bucket's stretch of the bitmap, with a bit for each name that at least two rows sent. Beyond 2 * most names
    those that came three times are dropped."""
    import numpy as np
    import pyarrow as pa

    size = bits // buckets

    def row(bucket, held):
        every = np.sort(np.concatenate(held))
        shared = every[1:][every[1:] == every[:-1]]
        found = np.zeros(size, dtype=bool)
        found[(shared % np.uint64(bits) % np.uint64(size)).astype(np.int64)] = True
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], names=["bucket", "bits"])

    at, held, many = None, [], 0
    for batch in batches:
        for bucket, high, low in read_rows(batch, "bucket", "high", "low"):
            if bucket != at and held:
                yield row(at, held)
                held, many = [], 0
            at = bucket
            held.append(np.frombuffer(high, "<u4").astype(np.uint64) << np.uint64(16) | np.frombuffer(low, "<u2"))
            many += len(held[-1])
            if many > 2 * most + len(held[0]):
                every = np.sort(np.concatenate(held))
                keep = np.ones(len(every), dtype=bool)
                keep[2:] = every[2:] != every[:-2]
                held, many = [every[keep]], 0
    if held:
        yield row(at, held)


def _answer(slice_id, keys, docs, values, more):
    import pyarrow as pa

    columns = [pa.array([slice_id], pa.int64()), *(pa.array([x], pa.binary()) for x in (keys, docs, values, more))]
    return pa.RecordBatch.from_arrays(columns, names=["slice", "keys", "docs", "values", "more"])


def _to_rows(batches):
    """(k1, k2, found) for each row of a slice that holds windows to be removed: their places."""
    import numpy as np
    import pyarrow as pa

    for _, rows in runs(batches, "slice", ["keys", "docs", "values", "more"]):
        own = next((row for row in rows if row[0] is not None), None)
        if own is None:
            continue
        keys = np.frombuffer(own[0], "<i8").reshape(-1, 2)
        repeated, at, group = (np.frombuffer(x, t) for x, t in zip(own[1:], ("<u2", "<u4", "<u4")))
        least = np.full(int(group.max()) + 1 if len(group) else 0, NO_ID, dtype=np.int64)
        np.minimum.at(least, group, keys[repeated, 0])
        docs, places = [], []
        for _, d, v, m in (row for row in rows if row[0] is None):
            d, v = np.frombuffer(d, "<u2"), np.frombuffer(v, "<u4")
            one = d != REPEATED
            docs.append(d[one])
            places.append(v[one])
            np.minimum.at(least, v[~one], np.frombuffer(m, "<i8"))
        later = keys[repeated, 0] > least[group]
        docs, places = np.concatenate([*docs, repeated[later]]), np.concatenate([*places, at[later]])
        if not len(docs):
            continue
        order = np.argsort(docs, kind="stable")
        docs, places = docs[order], places[order].astype("<u4")
        mine, first = np.unique(docs, return_index=True)
        blobs = [x.tobytes() for x in np.split(places, first[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(keys[mine, 0]), pa.array(keys[mine, 1]), pa.array(blobs, pa.binary())], names=["k1", "k2", "found"])


def _bitmap(shared: DataFrame, buckets: int, bits: int) -> bytes:
    """The bitmap of so many bits, from its stretches."""
    size = bits // buckets // 8
    out = bytearray(bits // 8)
    for row in shared.collect():  # the bitmap's size in all, whatever the number of names
        out[row["bucket"] * size : (row["bucket"] + 1) * size] = row["bits"]
    return bytes(out)


def _send_windows(batches, buckets: int, window: int, bits: int, told):
    """told: the broadcast bitmap of shared anchors."""
    import numpy as np

    bitmap = np.frombuffer(told.value, dtype=np.uint8)
    for batch in batches:
        for part in slices(batch):
            got = _slice_rows(part)
            if got is None:
                continue
            x, bounds, text, begins, keys, slice_id = got
            symbols = recompressed(x, bounds, window)
            name, has, whole = anchors(x, bounds, window, symbols=symbols)
            place = (name >> np.uint64(16)) % np.uint64(bits)
            known = (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & has
            at = np.nonzero(whole & (known | ~has))[0]
            if not len(at):
                continue
            high, low = window_names(x, symbols, at, window)
            low = (low >> np.uint64(32)).astype("<u4")
            docs = text[at].astype("<u2")
            places, ids = (at - begins[docs]).astype("<u4"), keys[docs, 0]
            # windows that the slice repeats go to their bucket once, with their least id; their places stay with the slice
            order = np.lexsort((low, high))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
            begin = np.nonzero(new)[0]
            sizes = np.diff(np.append(begin, len(order)))
            once, more = order[begin[sizes == 1]], begin[sizes > 1]
            least = np.minimum.reduceat(ids[order], begin)[sizes > 1]
            again = order[np.repeat(sizes > 1, sizes)]
            group = np.repeat(np.arange(len(more), dtype="<u4"), sizes[sizes > 1])
            yield pack(slice_id, slice_id % buckets, keys=keys, docs=docs[again], ids=None, places=places[again], high=group, low=None)
            first = order[more]
            names = np.concatenate([high[once], high[first]])
            yield from by_bucket(
                names % np.uint64(buckets), buckets, slice_id, {"keys": None}, docs=np.concatenate([docs[once], np.full(len(more), REPEATED, dtype="<u2")]),
                ids=np.concatenate([ids[once], least]), places=np.concatenate([places[once], np.arange(len(more), dtype="<u4")]),
                high=names.astype("<u8"), low=np.concatenate([low[once], low[first]]),
            )


def _answer_windows(batches):
    """Sends back the places of windows whose least id is less than their own, and for repeated ones that id."""
    import numpy as np

    for _, rows in runs(batches, "bucket", ["slice", "keys", "docs", "ids", "places", "high", "low"]):
        asked = []
        for slice_id, keys, docs, ids, places, high, low in rows:
            if keys is not None:
                yield _answer(slice_id, keys, docs, places, high)
            else:
                asked.append((slice_id, *(np.frombuffer(x, t) for x, t in ((docs, "<u2"), (ids, "<i8"), (places, "<u4"), (high, "<u8"), (low, "<u4")))))
        if not asked:
            continue
        ids, high, low = (np.concatenate([x[i] for x in asked]) for i in (2, 4, 5))
        order = np.lexsort((low, high))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        least = np.empty(len(order), dtype=np.int64)
        least[order] = np.minimum.reduceat(ids[order], np.nonzero(new)[0])[np.cumsum(new) - 1]
        begin = 0
        for slice_id, docs, own, places, *_ in asked:
            told = least[begin : begin + len(own)]
            begin += len(own)
            found = own > told
            if found.any():
                yield _answer(slice_id, None, docs[found].tobytes(), places[found].tobytes(), told[found & (docs == REPEATED)].astype("<i8").tobytes())


def _remove(batches, window: int):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in slices(batch):
            total, removed, kept = [], [], []
            for body, found in zip(byte_texts(part), part.column("found").to_pylist()):
                words = body.split()
                total.append(len(words))
                if found is None:
                    removed.append(0)
                else:
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    places = np.frombuffer(found, "<u4")
                    np.add.at(steps, places, 1)
                    np.add.at(steps, places + window, -1)
                    out = np.cumsum(steps)[:-1] > 0
                    removed.append(int(out.sum()))
                    words = [w for w, x in zip(words, out.tolist()) if not x]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: kept is its words, without those in windows that also start in a
    row with a smaller id, joined by one space."""
    rows = _keyed(docs, key, text)
    buckets, bits, most = bucket_count(docs), FILTER_BITS, MERGE_NAMES
    answers = "slice long, keys binary, docs binary, values binary, more binary"

    sends = "bucket int, slice long, high binary, low binary"
    sends_windows = "bucket int, slice long, keys binary, docs binary, ids binary, places binary, high binary, low binary"

    def dealt(sent: DataFrame) -> DataFrame:
        return sent.repartition("bucket").sortWithinPartitions("bucket", "slice")

    plain = rows.select("k1", "k2", "text")
    sent = plain.mapInArrow(lambda b: _send_anchors(b, buckets, window, bits), sends)
    shared = dealt(sent).mapInArrow(lambda b: _find_shared(b, buckets, bits, most), "bucket int, bits binary")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(shared, buckets, bits))
    sent = plain.mapInArrow(lambda b: _send_windows(b, buckets, window, bits, bitmap), sends_windows)
    back = dealt(sent).mapInArrow(_answer_windows, answers).repartition("slice").sortWithinPartitions("slice")
    each = back.mapInArrow(_to_rows, "k1 long, k2 long, found binary")
    found = each.groupBy("k1", "k2").agg(F.first("found").alias("found"))  # rows that are alike got the same answer
    with_places = rows.join(found.hint("merge"), ["k1", "k2"], "left")
    return with_places.select("doc_id", "text", "found").mapInArrow(
        lambda b: _remove(b, window), "doc_id long, n_words long, n_removed long, kept string"
    )


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT rid, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
),
rep AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < coalesce(doc_id, 9223372036854775807)),
gone AS (SELECT DISTINCT rid, i + k AS i FROM rep, range(0, 13) AS r(k)),
each AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
left_ AS (
  SELECT each.rid, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY each.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM each LEFT JOIN gone ON each.rid = gone.rid AND each.i = gone.i GROUP BY each.rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_ USING (rid)
"""
