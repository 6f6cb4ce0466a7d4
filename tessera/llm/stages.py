"""The stages of ``corpus_pipeline``: one operator each, whose decisions take effect.

All but the last return the columns of their input. Rows are judged one by one, so
null and repeated ids need no join except where a group of duplicates is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, neardup, packing, pii, quality
from .common import crc_bucket, pipeline_stage, read_table


@pipeline_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It is learned from the
    labelled documents of ``docs``, the held-out fifth left out."""
    labels = read_table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    scored = quality.classify(docs, quality.train(docs, labels), [whole])
    return scored.where(F.col("predicted") == 1).select("doc.*")


@pipeline_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without words all stay."""
    return neardup.deduplicate(docs)


@pipeline_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


@pipeline_stage
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span replaced by its kind; ``n_chars`` follows the text."""
    rest = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")
    out = pii.detect(docs, [rest])
    found = F.col("spans") != ""

    def column(name: str) -> Column:
        if name == "text":
            return F.col("redacted").alias("text")
        old = F.col("doc").getField(name)
        return (F.when(found, F.length("redacted").cast(docs.schema[name].dataType)).otherwise(old) if name == "n_chars" else old).alias(name)

    return out.select(*[column(c) for c in docs.columns])


@pipeline_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed stream of all documents that arrive."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("neardup", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact_pii), ("packing", pack)]
