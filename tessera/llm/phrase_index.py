"""Places of word phrases in whole texts, with DataFrame functions only.

Every text becomes its array of words; each position emits one token (a shingle of
``size`` words), probed against a small broadcast index ``token -> postings``. What
stands around a matched position is then compared with the postings exactly, so the
token hash only proposes. Each document also emits one end marker, which the index
answers with no posting: documents without a match come through the same single pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = -1


def words(text: Column) -> Column:
    """Lower-cased words of a whole text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(ascii_lower(text), F.lit("")), F.lit(WORD), F.lit(0))


def shingle(at: Column, size: int) -> Column:
    """Token of the ``size`` words from position ``at`` (from 0) of column ``words``;
    never the end marker's."""
    h = F.xxhash64(*[F.get("words", at + j) for j in range(size)])
    return F.when(h == END, F.lit(0)).otherwise(h)


def numbered(docs: DataFrame, passes: int = 1) -> DataFrame:
    """``row, doc_id, text``: ``row`` keeps repeated and null ids apart. It is the same
    when a task of one pass runs again; for several passes it is written down first."""
    out = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return out if passes < 2 else staged(out, "numbered")


def probe(docs: DataFrame, index: DataFrame, size: int, reach: int, with_end: bool = True) -> DataFrame:
    """``row, part, doc_id, n_words, at, low, near, postings``: every position whose token
    the broadcast ``index(token, postings)`` holds, with the words ``near`` it (up to
    ``reach`` on both sides, the first at position ``low``), and one end row (``at`` =
    n_words, no postings) for each document if ``with_end``.

    ``docs`` comes from ``numbered``. Words are spread, hashed, probed and cut to their
    surroundings in one generated loop, so a long text is never copied per position;
    the partition number in the projection keeps later filters from being pushed into
    the join, where they would break that loop apart.
    """
    spread = docs.select("row", "doc_id", words(F.col("text")).alias("words")).withColumn("n_words", F.size("words").cast("long"))
    end = F.array(F.lit(None).cast("string")) if with_end else F.array().cast("array<string>")
    at = spread.select("row", "doc_id", "n_words", "words",
                       F.posexplode(F.concat("words", end)).alias("at", "word"))
    token = F.when(F.col("at") == F.col("n_words"), F.lit(END).cast("long")).otherwise(shingle(F.col("at"), size))
    low = F.greatest(F.col("at") - reach, F.lit(0))
    return at.withColumn("token", token).join(F.broadcast(index), "token").select(
        "row", F.spark_partition_id().alias("part"), "doc_id", "n_words", "at", low.alias("low"),
        F.slice("words", low + 1, 2 * reach + 1).alias("near"), "postings")


def stands(first: Column, phrase: Column) -> Column:
    """Whether the words ``phrase`` stand in the text from position ``first``; they must
    lie within the row's reach."""
    return (first >= F.col("low")) & (first + F.size(phrase) <= F.col("n_words")) & (
        F.slice("near", F.greatest(first - F.col("low"), F.lit(0)) + 1, F.size(phrase)) == phrase)


def with_end_row(index: DataFrame) -> DataFrame:
    """``index`` plus the end marker's empty posting list."""
    spark, kind = index.sparkSession, index.schema["postings"].dataType.simpleString()
    return index.unionByName(spark.range(1).select(F.lit(END).cast("long").alias("token"),
                                                   F.expr(f"cast(array() as {kind})").alias("postings")))
