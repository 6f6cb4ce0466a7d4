"""Stored values close to a literal, found by counting the q-grams that they share.

``d`` edits change at most ``q d`` of a text's q-grams, so two texts of which the longer
has ``n`` characters and that are within ``d`` edits share at least ``K`` positional q-grams,
each at most ``d`` places away: ``n + 1 - 2 d`` of the 2-grams between two marks, ``n - d``
single characters. With ``d`` the edits that the cutoff allows, only values of a fitting
length that share ``K`` q-grams are scored by Levenshtein distance.

At a low cutoff ``K`` is small and says little. But only the ``n`` best values are wanted,
so literals are asked at falling cutoffs (``LEVELS``): one that has ``n`` values at a level is
done, as all above the level were found. Columns of at most ``INDEX_FROM`` values are scored
without an index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import bounded
from ..session import ensure_checkpoint_dir

COLUMN = ["table_name", "column_name"]
LEVELS = ((0.85, 2), (0.7, 2), (0.6, 2), (0.5, 1))  # cutoff, q
INDEX_FROM = 1_000


def grams(text: Column, q: int) -> Column:
    """``(pos, gram)`` of a text, of 2-grams between two marks."""
    padded = F.concat(F.lit("\x01"), text, F.lit("\x02")) if q == 2 else text
    places = F.when(F.length(padded) >= q, F.sequence(F.lit(1), F.length(padded) - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.substring(padded, i, F.lit(q)).alias("gram")))


def edits(cutoff: float, longest: Column) -> Column:
    """Most edits at which two texts, the longer of this length, are within the cutoff."""
    return F.floor(F.lit(1 - cutoff) * longest + F.lit(1e-9))


def shared(cutoff: float, q: int, longest: Column) -> Column:
    """Least number of q-grams that they then share; 0 or less if the bound says nothing."""
    return longest + (q - 1) - q * edits(cutoff, longest)


def _longest() -> Column:
    return F.greatest(F.length("literal"), F.length("value"))


def fits(cutoff: float) -> Column:
    shorter = F.least(F.length("literal"), F.length("value"))
    return shorter >= F.lit(cutoff) * _longest() - F.lit(1e-9)


def candidates(needles: DataFrame, values: DataFrame, cutoff: float, q: int) -> DataFrame:
    """Distinct ``(needle_id, literal, value)`` that may be within the cutoff, of
    ``needles(needle_id, table_name, column_name, literal)``."""
    reach = F.greatest(F.length("literal"), F.floor(F.length("literal") / F.lit(cutoff) + F.lit(1e-9)).cast("int"))
    bound = F.array_min(F.transform(F.sequence(F.length("literal"), reach), lambda n: shared(cutoff, q, n)))
    asked = needles.withColumn("_k", bound)
    own = asked.where("_k >= 1").select("needle_id", *COLUMN, "literal", F.explode(grams(F.col("literal"), q)).alias("g")).select(
        "needle_id", *COLUMN, "literal", F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram"))
    postings = values.select(*COLUMN, "value", F.explode(grams(F.col("value"), q)).alias("g")).select(*COLUMN, "value", F.col("g.pos").alias("at"), F.col("g.gram").alias("gram"))
    hits = postings.join(bounded(own), [*COLUMN, "gram"]).where(fits(cutoff) & (F.abs(F.col("at") - F.col("pos")) <= edits(cutoff, _longest())))
    met = hits.groupBy("needle_id", "literal", "value", "pos").agg(F.lit(1).alias("_one")).groupBy("needle_id", "literal", "value").agg(F.count("_one").alias("_c"))
    direct = values.join(bounded(asked.where("_k < 1").drop("_k")), COLUMN).where(fits(cutoff))
    return met.where(F.col("_c") >= shared(cutoff, q, _longest())).select("needle_id", "literal", "value").unionByName(direct.select("needle_id", "literal", "value"))


def near(needles: DataFrame, values: DataFrame, score: Column, cutoff: float, best: Callable[[DataFrame], DataFrame], n: int,
         index_from: int = INDEX_FROM, seen: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """``needle_id, value, score`` of values within the cutoff: all that ``best``, which
    ranks and keeps ``n`` a needle, can need. ``seen`` is shown the pairs that are scored."""
    def scored(pairs: DataFrame, level: float) -> DataFrame:
        if seen:
            seen(pairs)
        return pairs.withColumn("score", score).where(F.col("score") >= level).select("needle_id", "value", "score")

    large = values.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > index_from).select(*COLUMN)
    large = bounded(large.join(needles.select(*COLUMN).distinct(), COLUMN, "left_semi"))
    few = bounded(needles.join(large, COLUMN, "left_anti"))
    out = scored(values.join(few, COLUMN).where(fits(cutoff)).select("needle_id", "literal", "value"), cutoff)
    left = needles.join(large, COLUMN, "left_semi").select("needle_id", *COLUMN, "literal")
    if left.isEmpty():
        return out
    ensure_checkpoint_dir(values.sparkSession)
    left = left.checkpoint()
    stored = values.join(large, COLUMN, "left_semi").select(*COLUMN, "value").checkpoint()
    for level, q in [x for x in LEVELS if x[0] > cutoff] + [(cutoff, 1)]:
        found = best(scored(candidates(left, stored, level, q), level)).select("needle_id", "value", "score").checkpoint()
        if level == cutoff:
            return out.unionByName(found)
        done = found.groupBy("needle_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select("needle_id")
        out = out.unionByName(found.join(done, "needle_id", "left_semi"))
        left = left.join(done, "needle_id", "left_anti").checkpoint()
        if left.isEmpty():
            return out
    return out
