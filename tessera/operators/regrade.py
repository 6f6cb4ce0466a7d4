"""GRD — re-grading a finished sweep: tallies, flips and the report.

Inputs: the run log (stored grades ``correct`` / ``draft_correct``), the new
grades per (arm, question) (``final_now`` / ``draft_now``), and whether a gold
answer exists. A draft whose SQL is missing (``''``, the partial rows recovered
from notebooks) is *ungradable*, not wrong; a row with no gold is *skipped*.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regrade(graded: DataFrame) -> DataFrame:
    """Per arm: rows, was/now for final and draft, ungradable drafts, skipped."""
    live = ~F.col("skipped")
    gradable = live & ~F.col("ungradable")
    return graded.groupBy("arm").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(live & F.col("correct")).alias("final_was"),
        F.count_if(live & F.col("final_now")).alias("final_now"),
        F.count_if(gradable & F.col("draft_correct")).alias("draft_was"),
        F.count_if(gradable & F.col("draft_now")).alias("draft_now"),
        F.count_if(live & F.col("ungradable")).alias("ungradable"),
        F.count_if(F.col("skipped")).alias("skipped"))


def flips(graded: DataFrame) -> DataFrame:
    """Rows whose grade moved: which grade (final / draft) and the direction."""
    final = graded.where(~F.col("skipped")).select(
        "arm", "question_id", F.lit("final").alias("grade"),
        F.col("correct").alias("was"), F.col("final_now").alias("now"))
    draft = graded.where(~F.col("skipped") & ~F.col("ungradable")).select(
        "arm", "question_id", F.lit("draft").alias("grade"),
        F.col("draft_correct").alias("was"), F.col("draft_now").alias("now"))
    moved = final.unionByName(draft).where(F.col("was") != F.col("now"))
    return moved.select("arm", "question_id", "grade",
                        F.when(F.col("now"), "gained").otherwise("lost").alias("direction"))


def regrade_report(tallies: DataFrame) -> DataFrame:
    """Percentages with the right denominators: final over graded rows, draft over
    *gradable* drafts only; NULL (shown '-') when a denominator is zero."""
    graded = F.col("rows") - F.col("skipped")
    gradable = graded - F.col("ungradable")
    pct = lambda num, den: F.round(F.try_divide(F.lit(100.0) * num, den), 4)
    return tallies.select(
        "arm",
        pct(F.col("final_was"), graded).alias("final_was_pct"),
        pct(F.col("final_now"), graded).alias("final_now_pct"),
        pct(F.col("draft_was"), gradable).alias("draft_was_pct"),
        pct(F.col("draft_now"), gradable).alias("draft_now_pct"))
