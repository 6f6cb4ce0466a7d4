"""AGG — leaderboards, deltas, contested questions, overlap, progress.

Inputs are run logs (one row per arm × question, see ``plans.derived``).
Every operator is a grouped aggregate (map-side partial aggregation, one
shuffle); per-arm baselines are one-row-per-arm frames joined back, whose size
is the number of arms.
Percentages are rounded to 4 places, the same on the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import bounded, one_row


def _pct(cond) -> F.Column:
    return F.round(F.lit(100.0) * F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)


def leaderboard(runs: DataFrame) -> DataFrame:
    return runs.groupBy("arm").agg(
        _pct(F.col("draft_correct")).alias("draft_acc"),
        _pct(F.col("correct")).alias("final_acc"),
        F.count_if(F.col("correct") & ~F.col("draft_correct")).alias("rescued"),
        F.count_if(F.col("repaired")).alias("repaired"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("calls"), 4).alias("calls_per_q"),
        F.round(F.avg("seconds"), 4).alias("seconds_per_q"))


def difficulty_pivot(runs: DataFrame, levels=("simple", "moderate", "challenging")) -> DataFrame:
    """Final accuracy per difficulty as columns; NULL (blank) when a level is empty.
    The pivot values are fixed, so Spark does not run a distinct-values job."""
    return (runs.groupBy("arm").pivot("difficulty", list(levels))
            .agg(F.round(F.lit(100.0) * F.avg(F.col("correct").cast("double")), 4)))


def delta_vs(board: DataFrame, baselines, metric: str = "final_acc") -> DataFrame:
    """Difference of ``metric`` from each named baseline arm (NULL on the baseline itself)."""
    if isinstance(baselines, str):
        baselines = [baselines]
    out = board
    for b in baselines:
        base = one_row(board.where(F.col("arm") == b).agg(F.max(metric).alias(f"_b_{b}")))
        out = (out.crossJoin(base)
               .withColumn(f"delta_{b}", F.when(F.col("arm") == b, F.lit(None))
                           .otherwise(F.round(F.col(metric) - F.col(f"_b_{b}"), 4)))
               .drop(f"_b_{b}"))
    return out


def accuracy_by(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """(correct, total, %) per difficulty and per trap in one GROUPING SETS pass;
    rows without a trap are excluded from the trap set."""
    j = runs.join(questions.select("question_id", "trap"), "question_id")
    g = (j.groupingSets([["difficulty"], ["trap"]], "difficulty", "trap")
         .agg(F.count_if("correct").alias("correct"), F.count(F.lit(1)).alias("total"),
              F.grouping_id().alias("_gid")))
    out = g.select(
        F.when(F.col("_gid") == 1, "difficulty").otherwise("trap").alias("dimension"),
        F.when(F.col("_gid") == 1, F.col("difficulty")).otherwise(F.col("trap")).alias("value"),
        "correct", "total",
        F.round(F.lit(100.0) * F.col("correct") / F.col("total"), 4).alias("pct"))
    return out.where(F.col("value").isNotNull())


def failed_to_run(runs: DataFrame) -> DataFrame:
    """Failures whose reason says *the query* failed to execute (case-sensitive)."""
    return runs.groupBy("arm").agg(
        F.count_if(~F.col("correct") & F.col("reason").contains("failed to execute")).alias("n_failed_to_run"))


def contested(runs: DataFrame) -> DataFrame:
    """Per question over every arm in the log: all / none / contested + sorted winners.
    Winners per question are bounded by the number of arms."""
    per_q = runs.groupBy("question_id").agg(
        F.bool_and("correct").alias("_all"), F.bool_or("correct").alias("_any"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("correct"), F.col("arm")))), ",").alias("winners"))
    status = (F.when(F.col("_all"), "always").when(~F.col("_any"), "never").otherwise("contested"))
    return per_q.select("question_id", status.alias("status"), "winners")


def top_reasons(runs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent whole crash reasons."""
    crashes = runs.where(F.col("reason").startswith("crashed"))
    return (crashes.groupBy("reason")
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "reason").limit(k))


def missing(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Database ids the runs need that are not present; failures per missing id."""
    needed = runs.select("db_id", "correct")
    gone = needed.join(found, "db_id", "left_anti")
    return gone.groupBy("db_id").agg(F.count_if(~F.col("correct")).alias("failures"),
                                     F.count(F.lit(1)).alias("runs"))


def mode_comparison(runs: DataFrame, baseline_mode: str = "none") -> DataFrame:
    board = runs.groupBy("mode").agg(
        _pct(F.col("correct")).alias("accuracy"),
        F.count_if("correct").alias("correct"),
        F.count_if("repaired").alias("repaired"),
        F.sum("calls").alias("attempts"),
        F.round(F.avg("calls"), 4).alias("calls_per_q"))
    base = one_row(board.where(F.col("mode") == baseline_mode).agg(F.max("accuracy").alias("_b")))
    return (board.crossJoin(base)
            .withColumn("delta", F.when(F.col("mode") == baseline_mode, F.lit(None))
                        .otherwise(F.round(F.col("accuracy") - F.col("_b"), 4)))
            .drop("_b"))


def routing_outcomes(runs: DataFrame) -> DataFrame:
    """Per configuration (arm): accuracy, verified count (tier = verify, i.e. not
    simple, or a mode that uses critique), calls/question, missed count."""
    verified = (F.col("difficulty") != "simple") | F.col("mode").isin("critique", "both")
    return runs.groupBy("arm").agg(
        _pct(F.col("correct")).alias("accuracy"),
        F.count_if(verified).alias("verified"),
        F.round(F.avg("calls"), 4).alias("calls_per_q"),
        F.count_if(~F.col("correct")).alias("n_missed"))


def routing_missed(runs: DataFrame) -> DataFrame:
    """The missed ids of ``routing_outcomes`` as rows (a per-arm list would grow
    with the question set inside one task)."""
    return runs.where(~F.col("correct")).select("arm", "question_id")


def overlap(runs: DataFrame, a: str, b: str) -> DataFrame:
    ra = runs.where(F.col("arm") == a).select("question_id", F.col("correct").alias("_a"))
    rb = runs.where(F.col("arm") == b).select("question_id", F.col("correct").alias("_b"))
    j = ra.join(rb, "question_id", "full_outer")
    ca, cb = F.coalesce(F.col("_a"), F.lit(False)), F.coalesce(F.col("_b"), F.lit(False))
    return j.agg(F.count_if(ca & cb).alias("both"), F.count_if(ca & ~cb).alias("only_a"),
                 F.count_if(~ca & cb).alias("only_b"), F.count_if(ca | cb).alias("either"))


def gap_by_size(runs: DataFrame, baseline: str, sizes=("1.5B", "3B", "7B")) -> DataFrame:
    """Gap behind the baseline per model size, its change from the next smaller
    size, and that change's share of the total narrowing (smallest → largest).
    Windows run per arm over at most ``len(sizes)`` rows."""
    acc = runs.groupBy("arm", "model_size").agg(F.avg(F.col("correct").cast("double")).alias("_acc"))
    base = acc.where(F.col("arm") == baseline).select("model_size", F.col("_acc").alias("_base"))
    order = F.when(F.col("model_size") == sizes[0], 0)
    for i, s in enumerate(sizes[1:], 1):
        order = order.when(F.col("model_size") == s, i)
    g = (acc.join(bounded(base, 1000), "model_size").where(F.col("arm") != baseline)
         .withColumn("_ord", order)
         .withColumn("gap", F.lit(100.0) * (F.col("_base") - F.col("_acc"))))
    w = Window.partitionBy("arm").orderBy("_ord")
    wall = Window.partitionBy("arm")
    g = (g.withColumn("change", F.col("gap") - F.lag("gap").over(w))
         .withColumn("_total", F.first("gap").over(wall.orderBy("_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                     - F.last("gap").over(wall.orderBy("_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return g.select("arm", "model_size", F.round("gap", 4).alias("gap"), F.round("change", 4).alias("change"),
                    F.round(F.try_divide(-F.col("change"), F.col("_total")), 4).alias("share"))


def submitted(runs: DataFrame, action: str) -> DataFrame:
    return runs.groupBy("arm").agg(
        F.count_if(F.array_contains("agents", action)).alias("n_with"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.lit(100.0) * F.count_if(F.array_contains("agents", action)) / F.count(F.lit(1)), 4).alias("pct"))


def action_counts(runs: DataFrame) -> DataFrame:
    return (runs.select(F.explode("agents").alias("action"))
            .groupBy("action").agg(F.count(F.lit(1)).alias("n")))


def failures(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Wrong answers with question, reason, produced and reference SQL on one line."""
    bad = runs.where(~F.col("correct")).join(questions.select("question_id", "question", "gold_sql"), "question_id")
    return bad.select("arm", "question_id", F.concat_ws(
        " | ", F.concat(F.lit("q"), F.col("question_id").cast("string"), F.lit(": "), F.col("question")),
        F.concat(F.lit("reason: "), F.col("reason")),
        F.concat(F.lit("got: "), F.col("sql")),
        F.concat(F.lit("gold: "), F.col("gold_sql"))).alias("line"))


def progress(runs: DataFrame, questions: DataFrame, arms: DataFrame) -> DataFrame:
    """Done per requested arm against the question total; arms with no rows show 0.
    A crashed row counts as done."""
    total = one_row(questions.agg(F.count(F.lit(1)).alias("total")))
    done = runs.groupBy("arm").agg(F.count(F.lit(1)).alias("done"))
    return (arms.join(done, "arm", "left").crossJoin(total)
            .select("arm", F.coalesce("done", F.lit(0)).alias("done"), "total",
                    (F.coalesce("done", F.lit(0)) >= F.col("total")).alias("complete")))


def describe(questions: DataFrame, levels=("simple", "moderate", "challenging")) -> DataFrame:
    return questions.agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.count_distinct("db_id").alias("n_databases"),
        *[F.count_if(F.col("difficulty") == lv).alias(lv) for lv in levels])
