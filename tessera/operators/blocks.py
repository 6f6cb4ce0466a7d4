"""Matching-blocks similarity: twice the characters in matching blocks over all characters.

The longest common block of two texts (the earliest in the value, then the earliest in the
literal) is taken, then the longest to its left and to its right, and so on. It is
case-sensitive, and moved words cost less than by edit distance.

No block can hold more than the characters that both texts have, counted with repeats. So
pairs that cannot reach the cutoff by length or by these counts are dropped in JVM
expressions, and only the rest is scored, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import bounded
from .values import MAX_VALUES, VALUE_CUTOFF, _top_k

COLUMN = ["table_name", "column_name"]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """Characters of ``a`` and ``b`` in matching blocks."""
    total, open_parts = 0, [(0, len(a), 0, len(b))]
    while open_parts:
        a0, a1, b0, b1 = open_parts.pop()
        if a0 == a1 or b0 == b1:
            continue
        part, best, at = b[b0:b1], 0, (0, 0)
        streak = np.zeros(len(part) + 1, np.int64)  # of the block that ends at a[i], part[j - 1]
        for i in range(a0, a1):
            streak[1:] = np.where(part == a[i], streak[:-1] + 1, 0)
            j = int(streak.argmax())
            if streak[j] > best:
                best, at = int(streak[j]), (i + 1, b0 + j)
        if best:
            total += best
            open_parts += [(a0, at[0] - best, b0, at[1] - best), (at[0], a1, at[1], b1)]
    return total


def ratio(value: str, literal: str) -> float:
    """Similarity of two texts, 1 if both are empty."""
    both = len(value) + len(literal)
    return 2.0 * matched(_codes(value), _codes(literal)) / both if both else 1.0


def block_ratio(value: str, literal: str) -> Column:
    """``ratio`` of two columns."""
    def score(values: pd.Series, literals: pd.Series) -> pd.Series:
        return pd.Series([ratio(v, x) for v, x in zip(values, literals, strict=True)], dtype="float64")

    return F.pandas_udf(score, "double")(value, literal)


def reachable(value: Column, literal: Column) -> Column:
    """The most that the similarity of two texts can be, by the characters both have."""
    def count(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    both = F.length(value) + F.length(literal)
    letters = F.filter(F.array_distinct(F.split(literal, "")), lambda c: c != "")
    common = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(count(value, c), count(literal, c)))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * common / both)


def closest_by_blocks(needles: DataFrame, dictionary: DataFrame, n: int = MAX_VALUES, cutoff: float = VALUE_CUTOFF,
                      seen: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """``needle_id, rank, value, score, close``: per needle the stored values of its column
    with a similarity of ``cutoff`` or more, best first and ties by the greater value, then
    the remaining values, smallest first, ``n`` in all. ``needles(needle_id, table_name,
    column_name, literal)``; null literals and values are not looked at. ``seen`` is shown
    the pairs that are scored."""
    asked = needles.where(F.col("literal").isNotNull()).select("needle_id", *COLUMN, "literal")
    stored = dictionary.where(F.col("value").isNotNull()).select(*COLUMN, "value")
    v, x = F.col("value"), F.col("literal")
    shorter, both = F.least(F.length(v), F.length(x)), F.length(v) + F.length(x)
    pairs = stored.join(bounded(asked), COLUMN).where(2 * shorter >= cutoff * both - 1e-9).where(reachable(v, x) >= cutoff - 1e-9)
    pairs = pairs.select("needle_id", "literal", "value")
    if seen:
        seen(pairs)
    scored = pairs.withColumn("score", block_ratio("value", "literal")).where(F.col("score") >= cutoff)
    best = _top_k(scored, "needle_id", [F.desc("score"), F.desc("value")], n).select("needle_id", "value", "score", "rank")
    found = best.groupBy("needle_id").agg(F.count(F.lit(1)).alias("found"))
    # Others are needed only where fewer than n are close, so the 2 n smallest of a column hold them.
    least = _top_k(stored.withColumn("_column", F.concat_ws(".", *COLUMN)), "_column", [F.col("value")], 2 * n).select(*COLUMN, "value")
    wanting = asked.join(found, "needle_id", "left").withColumn("found", F.coalesce("found", F.lit(0))).where(F.col("found") < n)
    rest = least.join(bounded(wanting), COLUMN).join(best.select("needle_id", "value"), ["needle_id", "value"], "left_anti")
    filled = _top_k(rest, "needle_id", [F.col("value")], n).withColumn("rank", F.col("rank") + F.col("found")).where(F.col("rank") <= n)
    filled = filled.withColumn("score", block_ratio("value", "literal"))
    out = best.select("*", F.lit(True).alias("close")).unionByName(filled.select("needle_id", "value", "score", "rank", F.lit(False).alias("close")))
    return out.select("needle_id", F.col("rank").cast("int").alias("rank"), "value", F.round("score", 4).alias("score"), "close")
