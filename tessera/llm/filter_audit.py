"""How document filters overlap: what each removes, in every order of applying them.

A document is the set (bit mask) of the filters it fails. All orders of ``n`` filters
are the paths through the lattice of subsets, from no filter applied to all of them. An
edge applies filter ``f`` after the set ``S`` and removes the documents whose mask holds
``f`` and nothing of ``S``, whatever the order within ``S``; so documents are counted by
mask once and every order is read from the same edges. A forward pass counts the orders
that reach each state, a backward pass those that leave it; an edge's removals times the
paths through it, summed by filter, is the filter's Shapley sum.

Failures (words are maximal runs of ``[^\\x20\\x09-\\x0D]``): A under 100 words, B under
80 % distinct words, C over 10 % of ``A-Z``, D any of ``#$%&*|``, E identical to the
text of a smaller ``doc_id`` anywhere in the table.

Scale: a text is reduced to (id, 256-bit key, part, mask) where it is read; its words
are counted a stretch at a time, so memory follows its distinct words. Copies are counted
by (key, part, mask, labels) before anything is compared, so a text that a third of the
table repeats is a few rows. From then on there are at most ``2**n`` rows a part.

Defined cases: a null text is empty (fails A alone, and E if repeated); a null ``lang``
is the part ``''``; a null id has no label, is smaller than none and so never fails E;
rows that repeat the smallest id of a text do not fail E. A document is good or toxic if
any of its label rows says so. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import extended

FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
MAX_FILTERS = 8  # 8! orders
STRETCH = 1 << 20

_SYMBOL = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_FOLLOWING = bytes(range(128, 192))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words, cut into stretches that end at a blank."""
    words, seen, at = 0, set(), 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            blank = _BLANK.search(text, end)
            end = blank.start() if blank else len(text)
        part = text[at:end].split()
        words += len(part)
        seen.update(part)
        at = end
    return words, len(seen)


def text_mask(text: bytes) -> int:
    """Failures of A to D as bits 0 to 3."""
    words, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _FOLLOWING))
    return ((words < MIN_WORDS) | (100 * distinct < DISTINCT_PERCENT * words) << 1
            | (100 * capitals > CAPITAL_PERCENT * points) << 2 | bool(_SYMBOL.search(text)) << 3)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, part, key, mask`` of every document; ``mask`` without E."""
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, masks = [], []
            for x in batch.column("text"):
                text = x.as_py()
                keys.append(hashlib.sha256(text).digest())
                masks.append(text_mask(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())],
                                             names=["doc_id", "part", "key", "mask"])

    return docs.mapInArrow(run, extended([docs.schema["doc_id"], docs.schema["part"]], "key binary, mask int"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the exact set of filters they fail."""
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = measured(docs).groupBy("doc_id", "key", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    no = F.lit(False)
    named = rows.where("doc_id IS NOT NULL").join(told, "doc_id", "left").withColumns({c: F.coalesce(c, no) for c in ("good", "toxic")})
    nameless = rows.where("doc_id IS NULL").withColumns({"good": no, "toxic": no})
    columns = ["doc_id", "key", "part", "mask", "n", "good", "toxic"]
    copies = named.select(*columns).unionAll(nameless.select(*columns)).groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("free"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("key"))  # rows of a key: parts and labels, not copies
    judged = copies.withColumn("repeats", F.col("n") - F.col("free") - F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    last = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("repeats")).alias("n")),
                    F.struct(F.col("mask").bitwiseOR(F.lit(last)).alias("mask"), F.col("repeats").alias("n")))
    each = judged.select("part", "good", "toxic", F.explode(split).alias("x")).where("x.n > 0")
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("x.n")).otherwise(0)).alias("toxic"))


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Orders from no filter to each state, and from each state to all filters."""
    states = 1 << n
    forward, backward = [1] + [0] * (states - 1), [0] * (states - 1) + [1]
    for s in range(1, states):
        forward[s] = sum(forward[s ^ 1 << f] for f in range(n) if s >> f & 1)
    for s in reversed(range(states - 1)):
        backward[s] = sum(backward[s | 1 << f] for f in range(n) if not s >> f & 1)
    return forward, backward


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """``before, filter, paths``: every edge and the number of orders through it."""
    forward, backward = path_counts(n)
    edges = [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    return spark.createDataFrame(edges, "before int, filter int, paths long")


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order and step what the step's filter removes, from ``cells(part, mask,
    n, good, toxic)``. ``filters`` names the bits of ``mask``, a letter each."""
    n, spark = len(filters), cells.sparkSession
    if n > MAX_FILTERS:
        raise ValueError(f"{n} filters have {n}! orders; at most {MAX_FILTERS} are audited")
    edges = lattice(spark, n)
    # every mask against every edge, by mask: 2**n * n * 2**(n-1) rows whatever the table
    masks = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("mask"))
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    fails = F.col("mask").bitwiseAND(bit) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    moves = masks.select("mask", "before", "filter", "paths", (fails & ~earlier).alias("here"), (fails & earlier).alias("late"),
                         (F.col("mask") == bit).alias("alone"), (~fails & ~earlier).alias("stays"))

    def total(of: str, when: str):
        return F.sum(F.when(F.col(when), F.col(of)).otherwise(0))

    steps = cells.join(F.broadcast(moves), "mask").groupBy("part", "before", "filter", "paths").agg(
        total("n", "stays").alias("kept"), total("n", "here").alias("removed"), total("n", "late").alias("redundant"),
        total("n", "alone").alias("unique_fails"), total("good", "here").alias("good_lost"), total("toxic", "here").alias("toxic_lost"))
    shapley = F.sum(F.col("removed") * F.col("paths")).over(Window.partitionBy("part", "filter"))
    orders = [("".join(filters[f] for f in order), k + 1, sum(1 << g for g in order[:k]), f)
              for order in permutations(range(n)) for k, f in enumerate(order)]
    orders = spark.createDataFrame(orders, "filter_order string, step int, before int, filter int")
    return steps.withColumn("shapley", shapley).join(F.broadcast(orders), ["before", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``; see the module."""
    return audit(cells(docs, labels))
