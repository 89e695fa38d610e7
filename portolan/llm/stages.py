"""Whole-corpus stages made of the operators: rows of documents in, rows of documents out.

Each stage works on all rows it gets, carries all their columns, and has the operator's defined results for nulls, empty
and very long texts, repeated rows, ties and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encode
from .common import table
from .decontamination import without_contaminated
from .near_dedup import one_of_each
from .personal_data import redacted
from .quality_rules import quality_rules

def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the quality rules keep."""
    judged = quality_rules(docs).where("kept")
    return judged.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item within its edit budget."""
    return without_contaminated(docs, benchmark)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by its kind; n_chars, where it is a column, follows the text."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of the documents; the last is of the bytes that the ids decode to."""
    coded = encode(docs, path, pattern, decode=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_personal_data(docs)


def encoding_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
