"""GRD — are two result sets equal, and if not, how do they differ.

Comparison is positional (column order matters, names do not; an extra
column is wrong) on normalised cells. The unordered compare is one signed-count
aggregate: +1 per predicted row, −1 per reference row, grouped by the row; any
non-zero group is a difference. That is one shuffle with map-side combining, no
sort, and it never brings a result set to the driver. The ordered compare adds
each side's explicit position to the grouping key (a DataFrame has no inherent
order, so the caller supplies the position column).

Differences from the reference, on purpose: no 500-row truncation before
comparing; NULL is not equal to the text 'None'.
"""

from __future__ import annotations

import threading
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalise import normalise, row_key, row_text
from ..plans.ordered import ordered_scan
from ..session import ensure_checkpoint_dir


def _positioned(df: DataFrame, pos_col: str | None) -> DataFrame:
    """(row, _pos): normalised cells of every column but the position column."""
    body = [f for f in df.schema.fields if f.name != pos_col]
    pos = F.col(pos_col).cast("long") if pos_col else F.lit(None).cast("long")
    return df.select(F.array(*[normalise(F.col(f"`{f.name}`"), f.dataType) for f in body]).alias("row"),
                     pos.alias("_pos"))


def signed_counts(pred: DataFrame, gold: DataFrame, pred_pos: str | None = None,
                  gold_pos: str | None = None) -> DataFrame:
    """(row, pos, pred_n, gold_n) for every distinct row (and position when ordered)."""
    p = _positioned(pred, pred_pos).select("row", "_pos", F.lit(1).alias("_p"), F.lit(0).alias("_g"))
    g = _positioned(gold, gold_pos).select("row", "_pos", F.lit(0).alias("_p"), F.lit(1).alias("_g"))
    return (p.unionByName(g).groupBy("row", "_pos")
            .agg(F.sum("_p").alias("pred_n"), F.sum("_g").alias("gold_n")))


def compare(pred: DataFrame, gold: DataFrame, pred_pos: str | None = None, gold_pos: str | None = None,
            label: str | None = None) -> DataFrame:
    """One-row verdict: correct, reason, predicted and reference row counts."""
    ncols_p = len([c for c in pred.columns if c != pred_pos])
    ncols_g = len([c for c in gold.columns if c != gold_pos])
    sc = signed_counts(pred, gold, pred_pos, gold_pos)
    width_differs = int(ncols_p != ncols_g)  # different widths can never match
    s = sc.agg(F.coalesce(F.sum("pred_n"), F.lit(0)).alias("pred_rows"),
               F.coalesce(F.sum("gold_n"), F.lit(0)).alias("gold_rows"),
               F.count_if(F.col("pred_n") != F.col("gold_n")).alias("_diff"),
               F.lit(width_differs).alias("_w"))
    # Two empty results are equal whatever their width, as two empty lists are.
    correct = (F.col("_diff") == 0) & ((F.col("_w") == 0) | ((F.col("pred_rows") == 0) & (F.col("gold_rows") == 0)))
    reason = (F.when(correct, "match")
              .when(F.col("pred_rows") != F.col("gold_rows"),
                    F.concat(F.lit("row count differs: got "), F.col("pred_rows").cast("string"),
                             F.lit(", expected "), F.col("gold_rows").cast("string")))
              .otherwise("same row count, different values"))
    out = s.select(correct.alias("correct"), reason.alias("reason"),
                   F.col("pred_rows").cast("long").alias("pred_rows"),
                   F.col("gold_rows").cast("long").alias("gold_rows"))
    if label is not None:
        out = out.select(F.lit(label).alias("pair"), "*")
    return out


def diff_rows(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """The rows behind a mismatch: missing (only in the reference), extra (only
    predicted), or multiplicity (in both, different counts)."""
    sc = signed_counts(pred, gold).where(F.col("pred_n") != F.col("gold_n"))
    kind = (F.when(F.col("pred_n") == 0, "missing").when(F.col("gold_n") == 0, "extra")
            .otherwise("multiplicity"))
    return sc.select(row_text(F.col("row")).alias("row_text"),
                     F.col("pred_n").cast("long").alias("pred_n"),
                     F.col("gold_n").cast("long").alias("gold_n"), kind.alias("kind"))


def wants_order(sql_col) -> F.Column:
    """Does the *reference* query claim an order (substring ``order by``)."""
    return F.lower(sql_col).contains("order by")


def fingerprint(df: DataFrame, group_cols: list[str], value_cols: list[str], normalised: bool = False) -> DataFrame:
    """Order-free key of each group's result set, computed as a partial
    aggregate: (row count, Σ of two 60-bit slices of md5(row text)). Equal
    multisets give equal keys; a match is confirmed by :func:`compare`.
    ``normalised=False`` is the reference's behaviour (4 and 4.0 differ)."""
    fields = [df.schema[c] for c in value_cols]
    if normalised:
        row = F.array(*[normalise(F.col(f.name), f.dataType) for f in fields])
    else:
        row = F.array(*[F.col(f.name).cast("string") for f in fields])
    txt = F.md5(row_key(row))
    h1 = F.conv(F.substring(txt, 1, 15), 16, 10).cast("decimal(38,0)")
    h2 = F.conv(F.substring(txt, 16, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.sum(h1).cast("string").alias("fp1"),
                                       F.sum(h2).cast("string").alias("fp2"))


def is_empty(log: DataFrame) -> DataFrame:
    """Success with zero rows — a state distinct from failure."""
    return log.withColumn("is_empty", F.col("ok") & (F.col("row_count") == 0))


class QueryRuns:
    """Results of query texts, each run and frozen once however many ask for it, and
    however many at the same time."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock, self._runs = spark, threading.Lock(), {}
        ensure_checkpoint_dir(spark)

    def _once(self, key: tuple, make):
        with self._lock:
            first = key not in self._runs
            run = self._runs.setdefault(key, Future())
        if first:
            try:
                run.set_result(make())
            except Exception as e:
                run.set_exception(e)
        return run.result()

    def frame(self, sql: str) -> DataFrame:
        """The analysed query."""
        def make():
            df = self.spark.sql(sql)
            df.schema  # noqa: B018 - forces analysis
            return df
        return self._once((sql, None), make)

    def frozen(self, sql: str, ordered: bool) -> DataFrame:
        """Its rows, with their positions if ``ordered``."""
        return self._once((sql, ordered), lambda: _with_row_pos(self.frame(sql)) if ordered else self.frame(sql).checkpoint(eager=True))


def execution_accuracy(spark: SparkSession, pred_sql: str | None, gold_sql: str,
                       gold_ordered: bool | None = None, runs: QueryRuns | None = None) -> tuple[bool, str, int | None, int | None]:
    """Run both queries and classify: no query / reference failed / query failed /
    match / counts differ / values differ. Each side's rows stay on the cluster;
    only the one-row verdict is collected. Ordered references compare row
    positions (``row_number`` over the reference's own output order). The texts of the
    verdicts are fixed values."""
    if not pred_sql or not pred_sql.strip():
        return False, "no query produced", None, None
    runs = runs or QueryRuns(spark)
    ordered = ("order by" in gold_sql.lower()) if gold_ordered is None else gold_ordered
    sides = (("REFERENCE QUERY FAILED", gold_sql), ("query failed", pred_sql))
    for step in (runs.frame, lambda sql: runs.frozen(sql, ordered)):  # analysed first, both; then each run on its own
        for failed, sql in sides:
            try:
                step(sql)
            except Exception as e:  # a failure is charged to the query that failed
                return False, f"{failed}: {first_line(e)}", None, None
    pred, gold = (runs.frozen(sql, ordered) for sql in (pred_sql, gold_sql))
    r = (compare(pred, gold, "_rowpos", "_rowpos") if ordered else compare(pred, gold)).first()
    return bool(r["correct"]), r["reason"], int(r["pred_rows"]), int(r["gold_rows"])


def _with_row_pos(df: DataFrame) -> DataFrame:
    """Dense position of each row in the frame's output order.

    ``monotonically_increasing_id`` follows the output order (partition index,
    then index inside the partition) but is sparse and would change if the sort
    were recomputed, so the frame is checkpointed first (to the cluster's
    ``spark.checkpoint.dir``); the dense position is then a skew-safe ordered
    scan over the frozen ids."""
    frozen = df.withColumn("_mono", F.monotonically_increasing_id()).checkpoint(eager=True)
    return ordered_scan(frozen, [], ["_mono"], seq="_rowpos").drop("_mono")


def first_line(e: Exception) -> str:
    text = str(e).strip()
    return text.split("\n")[0] if text else type(e).__name__
