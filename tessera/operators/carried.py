"""Bounded notes of hot slots: a sequential rule run slice by slice at the same time.

A slot keeps distinct notes, the newest ``cap``: a note that is not held is appended and
the oldest beyond ``cap`` goes, so an evicted note may come back. What a note does depends
on all before it, so no window or aggregate states the rule.

Rows are range-partitioned on (run, slot, seq, note) and the cut is frozen by a reliable
checkpoint; what a slice holds of a slot is a *piece*. Every piece is run from an empty
slot at once. A piece must begin with what the piece before it ends with; where it did
not, it is run again from there, beside its former run, and only until both hold the same
notes in the same order, as from then on they agree. Rounds go on until every piece begins
as it must. Each round settles at least the first unsettled piece of a slot, so there are
at most as many rounds as slices; two are usual. No task reads more than its slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import same, slices
from ..session import ensure_checkpoint_dir

PIECE = ["run_id", "slot", "piece"]
_PIECES = "run_id string, slot string, piece int, begin array<string>, end array<string>, n_read long"


def _take(held: list[str], note: str | None, cap: int) -> None:
    if note and note not in held:
        held.append(note)
        if len(held) > cap:
            del held[0]


class _Piece:
    """One piece being run: from ``begin``, beside a former run (``was`` to ``ended``) if it had one."""

    def __init__(self, key: tuple, begin=None, was=None, ended=None):
        self.key, self.begin, self.held = key, list(begin or []), list(begin or [])
        self.was, self.ended, self.n_read = None if was is None else list(was), ended, 0

    def read(self, note: str | None, cap: int) -> None:
        if self.was is not None and self.held == self.was:
            return  # both runs agree: the former end stands
        self.n_read += 1
        _take(self.held, note, cap)
        if self.was is not None:
            _take(self.was, note, cap)

    def row(self) -> dict:
        end = self.ended if self.was is not None and self.held == self.was else self.held
        return dict(zip(PIECE, self.key, strict=True)) | {"begin": self.begin, "end": end, "n_read": self.n_read}


def _run(rows: DataFrame, cap: int) -> DataFrame:
    """``rows(run_id, slot, piece, note, begin, was, ended)``, the pieces one after another,
    a piece's header (with arrays, without a note) before its notes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("run_id", pa.string()), ("slot", pa.string()), ("piece", pa.int32()), ("begin", pa.list_(pa.string())),
                            ("end", pa.list_(pa.string())), ("n_read", pa.int64())])
        now = None
        for batch in batches:
            done = []
            for run_id, slot, piece, note, begin, was, ended in zip(*(batch.column(c).to_pylist() for c in (*PIECE, "note", "begin", "was", "ended")), strict=True):
                if now is None or now.key != (run_id, slot, piece):
                    if now is not None:
                        done.append(now.row())
                    now = _Piece((run_id, slot, piece), begin, was, ended)
                now.read(note, cap)
            yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return rows.select(*PIECE, "note", "begin", "was", "ended").mapInArrow(run, _PIECES)


def bounded_notes(notes: DataFrame, cap: int = 8, n_slices: int | None = None, seen: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """``run_id, slot, position, note``: what each slot of ``notes(run_id, slot, seq, note)``
    holds in the end, oldest first. Null and empty notes are passed over, notes of the same
    ``seq`` come in their own order; a null run or slot is one of its own. ``seen`` is shown
    the pieces after each round (``n_read``: the notes that were run through)."""
    spark = notes.sparkSession
    ensure_checkpoint_dir(spark)
    order = ["run_id", "slot", "seq", "note"]
    none = F.lit(None).cast("array<string>")
    rows = (notes.select(*order).repartitionByRange(n_slices or slices(spark), *order).sortWithinPartitions(*order)
            .withColumn("piece", F.spark_partition_id()).checkpoint())
    pieces = _run(rows.select("*", none.alias("begin"), none.alias("was"), none.alias("ended")), cap).checkpoint()
    # A slot within one slice is settled; of the others there are fewer than slices.
    slot = Window.partitionBy("run_id", "slot").orderBy("piece")
    while True:
        if seen:
            seen(pieces)
        due = pieces.withColumn("due", F.coalesce(F.lag("end").over(slot), F.array().cast("array<string>"))).where(F.col("due") != F.col("begin")).checkpoint()
        if due.isEmpty():
            break
        keys = [(c, c) for c in PIECE]
        again = rows.alias("r").join(due.select(*PIECE).alias("d"), same("r", "d", keys), "left_semi")
        told = again.select(*order, "piece", F.lit(1).alias("kind"), none.alias("begin"), none.alias("was"), none.alias("ended"))
        nothing = F.lit(None).cast("string").alias("note")
        heads = due.select("run_id", "slot", F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), nothing, "piece", F.lit(0).alias("kind"),
                           F.col("due").alias("begin"), F.col("begin").alias("was"), F.col("end").alias("ended"))
        new = _run(told.unionByName(heads).repartition(*PIECE).sortWithinPartitions(*PIECE, "kind", "seq", "note"), cap)
        kept = pieces.alias("p").join(due.select(*PIECE).alias("d"), same("p", "d", keys), "left_anti").withColumn("n_read", F.lit(0).cast("long"))
        pieces = kept.unionByName(new).checkpoint()
    last = pieces.groupBy("run_id", "slot").agg(F.max_by("end", "piece").alias("held"))
    return last.select("run_id", "slot", F.posexplode("held").alias("at", "note")).select("run_id", "slot", (F.col("at") + 1).alias("position"), "note")
