"""Token counts as delta-maintained rollups.

A batch of changes (``insert``, ``revise``, ``delete``) becomes signed rows: what a
document counted before with -1, what it counts now with +1. Totals by source,
language and tokenizer version are additive, so a batch adds its summed deltas and no
total is ever recomputed from the documents.

A batch is committed at most once, on the version of the rollup it was signed against
(``sources.versions``). If another batch was committed in between, it is signed again
against what is live then, so no two batches ever replace the same count. A batch that
was committed changes nothing when it is delivered again, and a writer that dies leaves
the last version as it was. After ``COMPACT`` batches the ledgers become one table of
live counts and the deltas one of totals, so what a batch reads is the live counts and a
few ledgers, however many batches there were.

``insert`` and ``revise`` both set a document's count under one tokenizer version;
``delete`` of an unknown document changes nothing. Several changes of one document in
a batch: the highest ``seq`` counts, then the largest (tokens, op). A document with a
null id cannot be referred to again: its insert is added as it is, a revise or delete is
ignored. Null sources and languages are groups of their own; null tokens count as 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import RETAIN_S, TRIES, Conflict, Version, VersionLog
from .packing import VOCABULARY, encoder

KEY = ["doc_id", "tokenizer_version"]
GROUP = ["source", "lang", "tokenizer_version"]
COMPACT = 8
CHANGE = "doc_id string, tokenizer_version string, source string, lang string, tokens long, op string, seq long"


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, lang, tokens`` of every whole text; a null text has none."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([len(encode(x)) // 4 for x in b.column("text").to_pylist()], pa.int64())],
                                             names=["doc_id", "source", "lang", "tokens"])

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(
        run, f"doc_id {id_type}, source string, lang string, tokens long")


def changes(rows: DataFrame, version: str, op: str, seq: int = 0) -> DataFrame:
    """Rows of ``doc_id`` (and ``source, lang, tokens`` unless deleted) as one kind of change."""
    have = set(rows.columns)
    cols = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "string"), ("source", "string"), ("lang", "string"), ("tokens", "long"))]
    return rows.select(*cols).withColumns({"tokenizer_version": F.lit(version), "op": F.lit(op), "seq": F.lit(seq).cast("long")}).select(*[c.split()[0] for c in CHANGE.split(", ")])


def signed(batch: DataFrame, live: DataFrame) -> DataFrame:
    """Signed rows ``doc_id, tokenizer_version, source, lang, tokens, sign`` of a batch
    against what is ``live`` (``doc_id, tokenizer_version, source, lang, tokens``)."""
    batch = batch.withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    last = batch.where(F.col("doc_id").isNotNull()).groupBy(*KEY).agg(F.max(F.struct("seq", "tokens", "op", "source", "lang")).alias("now"))
    old = live.select(*KEY, F.struct("source", "lang", "tokens").alias("old"))
    both = last.join(old, KEY, "left").withColumn("new", F.struct("now.source", "now.lang", "now.tokens"))
    gone, there = F.col("now.op") == "delete", F.col("old").isNotNull()
    minus = F.when(there & (gone | (F.col("old") != F.col("new"))), F.struct(F.col("old").alias("row"), F.lit(-1).alias("sign")))
    plus = F.when(~gone & (~there | (F.col("old") != F.col("new"))), F.struct(F.col("new").alias("row"), F.lit(1).alias("sign")))
    known = both.select(*KEY, F.explode(F.array_compact(F.array(minus, plus))).alias("d")).select(*KEY, "d.row.source", "d.row.lang", "d.row.tokens", "d.sign")
    nameless = batch.where(F.col("doc_id").isNull() & (F.col("op") == "insert")).select(*KEY, "source", "lang", "tokens", F.lit(1).alias("sign"))
    return known.unionByName(nameless)


LEDGER = "doc_id string, tokenizer_version string, source string, lang string, tokens long, sign int"
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


class Rollup:
    """A rollup in a folder that all executors share. Its state: the batches committed,
    and the folders of ledgers (signed rows) and deltas (their sums) that count."""

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT, retain_s: float = RETAIN_S):
        self.spark, self.path, self.compact_at, self.retain_s = spark, path.rstrip("/"), compact, retain_s
        self.log = VersionLog(spark, path)

    @staticmethod
    def _state(head: Version) -> dict:
        return head.state or {"batches": [], "ledgers": [], "deltas": []}

    def committed(self) -> list[str]:
        """Every committed batch."""
        return self._state(self.log.head())["batches"]

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _live(self, state: dict) -> DataFrame:
        rows = self._read(state["ledgers"], LEDGER)
        return (rows.where(F.col("doc_id").isNotNull()).groupBy(*KEY, "source", "lang", "tokens").agg(F.sum("sign").alias("n"))
                .where("n > 0").drop("n"))

    def live(self) -> DataFrame:
        """What each document counts now."""
        return self._live(self._state(self.log.head()))

    def _totals(self, state: dict) -> DataFrame:
        return self._read(state["deltas"], DELTA).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer_version, n_docs, n_tokens``: the sum of committed deltas."""
        return self._totals(self._state(self.log.head())).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def _write(self, df: DataFrame) -> str:
        folder = self.log.folder()
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, head: Version, state: dict, op: str) -> None:
        self.log.commit(head.number, state, state["ledgers"] + state["deltas"], op)

    def apply(self, batch_id: str, batch: DataFrame) -> bool:
        """Commit a batch; False if it was committed before, here or by another driver."""
        for _ in range(TRIES):
            head = self.log.head()
            state = self._state(head)
            if batch_id in state["batches"]:
                return False
            ledger = self._write(signed(batch, self._live(state)))
            rows = self._read([ledger], LEDGER)
            deltas = self._write(rows.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens")))
            try:
                self._commit(head, {"batches": [*state["batches"], batch_id], "ledgers": [*state["ledgers"], ledger], "deltas": [*state["deltas"], deltas]}, "batch")
            except Conflict:
                continue  # signed against counts that another batch has changed since
            if len(state["ledgers"]) + 1 >= self.compact_at:
                self.compact()
            return True
        raise Conflict(f"{batch_id}: {TRIES} batches in a row came between")

    def compact(self) -> bool:
        """Replace the ledgers by the live counts and the deltas by their totals; False if
        a batch was committed meanwhile (the next one compacts)."""
        head = self.log.head()
        state = self._state(head)
        new = state | {"ledgers": [self._write(self._live(state).select(*KEY, "source", "lang", "tokens", F.lit(1).alias("sign")))],
                       "deltas": [self._write(self._totals(state).select("source", "lang", "tokenizer_version", "n_docs", "n_tokens"))]}
        try:
            self._commit(head, new, "compact")
        except Conflict:
            return False
        self.log.vacuum(self.retain_s)
        return True
