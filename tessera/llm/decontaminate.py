"""Benchmark decontamination: a prefix-filtered set join, DataFrame functions only.

Items are cut into windows of ``window`` words (an item of fewer is one window). A
window occurs only where all its shingles occur, so its prefix is one shingle: the
rarest, by how many items hold it (ties by hash). The prefix is the same for
neighbouring windows, so windows are grouped by it and the index has one row per
prefix shingle. Documents are probed once; at a matching position the length bound
(the window must end inside the document) and the positional bound (its place
relative to the shingle) fix the only possible slice, which is compared word by word.

Size: the index grows with the benchmark, not with the documents. It is counted, and
beyond ``block`` prefix shingles it is dealt into blocks that are probed one by one,
so what is broadcast stays bounded.

Defined cases: a null text has no words and no hits; null item ids still mark words
but count as no item; repeated documents are judged one by one; an empty benchmark
or document table works; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, staged
from .phrase_index import numbered, probe, shingle, stands, with_end_row, words

WINDOW = 10
SHINGLE = 3
BLOCK = 50_000
MAX_BROADCAST_ROWS = 1_000_000


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, words (of the window), item, first``: every window of every item."""
    all_words = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"),
                             F.monotonically_increasing_id().alias("item")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (all_words.select("item_id", "item", "w", F.explode(starts).alias("first"))
            .select("item_id", "item", "first", F.expr(f"slice(w, first + 1, {window})").alias("words")))


def prefix_index(items: DataFrame, window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """``size, token, postings``: for each prefix shingle the windows it stands for,
    as ``(back, words, item_id)``, ``back`` being its distance from the window's start."""
    win = windows(items, window).withColumn("size", F.least(F.size("words"), F.lit(size)))
    at = win.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("back"))
    token = F.lit(0).cast("long")
    for k in range(1, size + 1):
        token = F.when(F.col("size") == k, shingle(F.col("back"), k)).otherwise(token)
    at = at.withColumn("token", token)
    held = at.groupBy("size", "token").agg(F.countDistinct("item").alias("held"))
    rarest = at.join(held, ["size", "token"]).groupBy("item", "first", "item_id", "words", "size").agg(
        F.min(F.struct("held", F.hash("token").alias("tie"), "token", "back")).alias("p"))
    return rarest.groupBy("size", F.col("p.token").alias("token")).agg(
        F.collect_set(F.struct(F.col("p.back").alias("back"), "words", "item_id")).alias("postings"))


def _matches() -> Column:
    """Postings that hold at the row's position, as ``(first, last, item_id)``."""
    def at_window(x):
        return F.col("at") - x["back"]

    holds = F.filter("postings", lambda x: stands(at_window(x), x["words"]))
    return F.transform(holds, lambda x: F.struct(
        at_window(x).alias("first"), (at_window(x) + F.size(x["words"]) - 1).alias("last"), x["item_id"].alias("item_id")))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted ``(first, last)`` spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(spans, start, lambda a, x: F.struct(
        (a["n"] + F.greatest(x["last"] - F.greatest(x["first"], a["end"] + 1) + 1, F.lit(0))).alias("n"),
        F.greatest(a["end"], x["last"]).alias("end")), lambda a: a["n"])


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK, rows: DataFrame | None = None) -> DataFrame:
    """One row per document: ``row, doc_id, n_words, spans (first, last, item_id)``;
    ``rows`` gives documents that have been numbered before."""
    index = staged(prefix_index(items, window), "prefix-index")
    sizes = index.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per shingle size, three at most
    blocks_of = {r["size"]: -(-r["n"] // block) for r in sizes} or {SHINGLE: 1}
    rows, passes = rows if rows is not None else numbered(docs, sum(blocks_of.values())), []
    for size, blocks in sorted(blocks_of.items()):
        for b in range(blocks):
            part = index.where(F.col("size") == size).drop("size")
            if blocks > 1:
                part = part.where(F.pmod(F.hash("token"), F.lit(blocks)) == b)
            end = not passes
            found = probe(rows, with_end_row(part) if end else part, size, window, with_end=end)
            passes.append(found.select("row", "part", "doc_id", "n_words", _matches().alias("spans"), (F.col("at") == F.col("n_words")).alias("end"))
                          .where(F.col("end") | (F.size("spans") > 0)))
    return (reduce(DataFrame.unionAll, passes).groupBy("row", "part", "doc_id", "n_words")
            .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).drop("part"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans``."""
    ids = F.array_sort(F.array_compact(F.array_distinct(F.transform("spans", lambda x: x["item_id"]))))
    return hits(docs, items, window, block).select(
        "doc_id", "n_words", _covered(F.col("spans")).cast("long").alias("n_hit"), ids.alias("items"), "spans").select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The documents without a hit, all their columns. Numbers are written down first;
    the contaminated ones are broadcast if few, else joined by shuffle."""
    held = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "numbered-docs")
    found = hits(docs, items, window, block, held.select("row", "doc.doc_id", "doc.text"))
    gone = staged(found.where(F.size("spans") > 0).select("row"), "contaminated")
    return held.join(bounded_broadcast(gone, MAX_BROADCAST_ROWS), "row", "left_anti").select("doc.*")
