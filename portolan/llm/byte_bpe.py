"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from the vocabulary.

The ranks become the pieces of a BPE model: each token's bytes are mapped to one printable character a byte, a piece's
score is its negative rank, and normalisation is the identity, so that sentencepiece merges in rank order. Texts are
cut into pre-tokens by the vocabulary's pattern and each pre-token is encoded separately; ids are decoded by the
inverse mapping.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows and null doc_ids are encoded
like any other row; other columns, whatever their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, CACHE_LENGTH, byte_texts, slices, table

#: Bytes of text whose pre-tokens are held at once.
PART_BYTES = 1 << 20

_MODELS: dict = {}


def byte_characters() -> list[str]:
    """The printable character for each byte: itself where it prints and isn't a space, else the next from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printing) else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens' bytes by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes after the last rank."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    chars = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t, n = model.trainer_spec, model.normalizer_spec
    t.model_type, t.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(tokens), -1, -1, -1
    n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary; one a worker process."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.tokens))
        self.split = regex.compile(pattern).findall
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.table = None
        self.forget()

    def forget(self) -> None:
        """Empties the cache: pre-token to its place in `ids`, between two of `edges`."""
        import numpy as np

        self.places: dict[str, int] = {}
        self.edges, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def mapped(self, pre_token: str) -> str:
        return pre_token.encode().decode("latin-1").translate(self.chars)

    def encode_flat(self, texts: list[str]):
        """(ids, edges): all texts' ids in one array, text i's between edges[i] and edges[i + 1]."""
        import numpy as np

        if len(self.edges) > CACHE_ENTRIES or len(self.ids) > CACHE_LENGTH * CACHE_ENTRIES // 8:
            self.forget()
        parts = [self.split(x) for x in texts]
        flat = [x for part in parts for x in part]
        places = self.places
        missing = list(set(flat).difference(places))
        if missing:
            found = self.model.encode([self.mapped(x) for x in missing], num_threads=1)
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            places.update(zip(missing, range(len(self.edges) - 1, len(self.edges) - 1 + len(missing))))
            self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), dtype=np.int32, count=int(sizes.sum()))])
        at = np.fromiter(map(places.__getitem__, flat), dtype=np.int64, count=len(flat))
        first, sizes = self.edges[at], self.edges[at + 1] - self.edges[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(first - (ends - sizes), sizes) + np.arange(total)]
        tokens = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        for x in missing:
            if len(x) > CACHE_LENGTH:
                del places[x]
        return ids, np.concatenate([[0], ends])[tokens]

    def decode_flat(self, ids, edges):
        """(bytes, edges): all texts' bytes in one string."""
        import numpy as np

        if self.table is None:
            self.table = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
            self.ends = np.cumsum([len(x) for x in self.tokens]).astype(np.int64)
            self.sizes = np.diff(self.ends, prepend=0)
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        shift = (self.ends[ids] - ends[1:]).astype(np.int32)
        body = self.table[np.repeat(shift, sizes) + np.arange(ends[-1], dtype=np.int32)]
        return body.tobytes(), ends[edges]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, edges = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(edges, edges[1:])]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _MODELS:
        _MODELS[path, pattern] = Codec(path, pattern)
    return _MODELS[path, pattern]


def _batches(batches, path, pattern, decode):
    import pyarrow as pa

    own = codec(path, pattern)
    for batch in batches:
        for part in slices(batch, size=PART_BYTES):
            ids, edges = own.encode_flat([x.decode() for x in byte_texts(part)])
            columns = [part.column("key"), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))]
            if decode:  # from the ids alone
                body, ends = own.decode_flat(ids, edges)
                buffers = [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(body)]
                columns.append(pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, buffers))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"][: len(columns)])


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
    """(key, ids array<int>) for each row, and decoded binary, made from the ids, if decode is true."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, ids array<int>" + ", decoded binary" * decode
    out = rows.mapInArrow(lambda b: _batches(b, path, pattern, decode), schema)
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded binary) for rows of ids; null ids decode to no bytes."""
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()

    def batches(parts):
        import pyarrow as pa

        own = codec(path, pattern)
        for part in parts:
            found = [own.decode(x or []) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found, pa.binary())], names=["key", "decoded"])

    return rows.mapInArrow(batches, f"key {kind}, decoded binary").withColumnRenamed("key", key)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    return coded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return digests(encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decode=True))
