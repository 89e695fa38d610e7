"""From raw documents to token ids: quality rules, near-dedup, benchmark decontamination, personal data, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from portolan.llm import stages
from portolan.llm.common import Scratch, table

STAGES = [
    ("quality_rules", stages.quality_stage),
    ("simhash_near_dedup", stages.near_dedup_stage),
    ("benchmark_decontamination", stages.decontamination_stage),
    ("personal_data", stages.personal_data_stage),
    ("byte_bpe", stages.encoding_stage),
]
#: The stages' fingerprints, edit distances and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; what each stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
