"""Token counts by a map-side two-tier lookup, without any pre-token shuffle.

The first tier is a compact table of frequent pre-tokens and their lengths in tokens, broadcast to the workers: the
vocabulary's own entries that are whole pre-tokens (a BPE vocabulary is made of the frequent ones), so its size is
bounded by the vocabulary's. Pre-tokens that miss it are encoded by the tokenizer and kept in a bounded cache of the
worker. Special tokens' strings inside a text count as the tokenizer's default has it: one token each.

Defined results: a null text is empty and has no tokens; repeated rows and null doc_ids are counted like any other;
other columns, whatever their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, CACHE_LENGTH, byte_texts, slices, table

LIMIT = 512

_COUNTERS: dict = {}


def frequent_lengths(path: str, pattern: str) -> bytes:
    """The packed first tier: each vocabulary entry that the pattern leaves whole, with its length in tokens.

    At most one entry a vocabulary item: half a MB for 50,000.
    """
    import regex
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    whole = regex.compile(pattern).fullmatch
    added = set(own.get_added_tokens_decoder())
    entries = [own.decode([i]) for i in range(own.get_vocab_size()) if i not in added]
    entries = [x for x in dict.fromkeys(entries) if x and "�" not in x and whole(x)]
    by_length: dict[int, list[str]] = {}
    for x, e in zip(entries, own.encode_batch(entries, add_special_tokens=False)):
        by_length.setdefault(len(e.ids), []).append(x)
    return zlib.compress(json.dumps(by_length).encode())


class Counter(dict):
    """Pre-token to length in tokens; what is missing is encoded."""

    def __init__(self, path: str, pattern: str, packed: bytes):
        import regex
        from tokenizers import Tokenizer

        super().__init__((x, int(n)) for n, xs in json.loads(zlib.decompress(packed)).items() for x in xs)
        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.split = regex.compile(pattern).findall
        special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.frequent = len(self)
        self.packed = packed

    def __missing__(self, pre_token: str) -> int:
        n = len(self.own.encode(pre_token, add_special_tokens=False).ids)
        if len(pre_token) <= CACHE_LENGTH:
            self[pre_token] = n
        return n

    def trim(self) -> None:
        if len(self) > self.frequent + CACHE_ENTRIES:
            self.clear()
            self.update((x, int(n)) for n, xs in json.loads(zlib.decompress(self.packed)).items() for x in xs)

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(x))) for x in parts)


def token_counts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) for each row."""
    packed = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path, pattern))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def batches(parts):
        import pyarrow as pa

        if (path, pattern) not in _COUNTERS:
            _COUNTERS[path, pattern] = Counter(path, pattern, packed.value)
        own = _COUNTERS[path, pattern]
        for batch in parts:
            for part in slices(batch):
                own.trim()
                texts = byte_texts(part)
                counts = pa.array([own.count(x.decode()) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(x) for x in texts], pa.int64()), counts], names=["key", "n_bytes", "n_tokens"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(batches, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
