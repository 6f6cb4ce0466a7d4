"""Corpus pipeline: quality, near-duplicates, decontamination, PII, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept
and returns a DataFrame that ``run`` writes as Parquet and rereads. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import forget, read_table, release, staged

STAGES = stages.STAGES

# Learned scores, near-duplicate groups and token ids are beyond SQL: tests/llm
# compares the stages with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    release(spark)
    return docs
