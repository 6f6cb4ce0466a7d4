"""WIN — attempt chains: first/last, actions, lessons, running totals, stalls.

Order-dependent values over *unbounded* groups (all attempts of a question,
all spans of a run, all completed questions of an arm) go through
``plans.ordered`` so a hot group is spread over many tasks. Windows are used
directly only over groups bounded by construction (a chain of at most
``max_attempts`` rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..plans.ordered import ordered_scan, previous_value


def first_last(tries: DataFrame) -> DataFrame:
    """First and last try of each question by (ts, event_id): partial aggregates."""
    order = F.struct("ts", "event_id")
    return tries.groupBy("arm", "question_id").agg(
        F.min_by("sql", order).alias("draft_sql"),
        F.max_by("sql", order).alias("final_sql"),
        F.min_by("ok", order).alias("draft_ok"),
        F.max_by("ok", order).alias("final_ok"),
        (F.count(F.lit(1)) > 1).alias("repaired"))


def attempt_actions(att: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Label each attempt of the bounded chain.

    accepted  — no feedback (the attempt ran ok);
    exhausted — feedback on the last allowed attempt (``max_attempts``, or the
                last try the log holds);
    no-change — the rewrite equals this attempt after whitespace folding; the chain ends;
    repairing — otherwise.
    The chain ends at its first non-repairing attempt; later rows are dropped.
    """
    c = att.where(F.col("attempt_no") <= max_attempts).select(
        "arm", "question_id", "attempt_no", "ok", "sql", "error")
    w = Window.partitionBy("arm", "question_id")  # at most max_attempts rows per group
    c = (c.withColumn("_last", F.max("attempt_no").over(w))
         .withColumn("_next_sql", F.lead("sql").over(w.orderBy("attempt_no"))))
    action = (F.when(F.col("ok"), "accepted")
              .when(F.col("attempt_no") == F.col("_last"), "exhausted")
              .when(one_line(F.col("_next_sql")) == one_line(F.col("sql")), "no-change")
              .otherwise("repairing"))
    c = c.withColumn("action", action)
    end = F.min(F.when(F.col("action") != "repairing", F.col("attempt_no"))).over(w)
    return (c.withColumn("_end", end).where(F.col("attempt_no") <= F.col("_end"))
            .select("arm", "question_id", "attempt_no", "sql", "action"))


def verified_lessons(att: DataFrame, max_attempts: int = 3) -> DataFrame:
    """A lesson only when an earlier attempt drew feedback, the chain's last
    attempt succeeded, and the SQL changed; the error is the first feedback."""
    acts = attempt_actions(att, max_attempts).join(
        att.select("arm", "question_id", "attempt_no", "ok", "error"), ["arm", "question_id", "attempt_no"])
    per = acts.groupBy("arm", "question_id").agg(
        F.min_by("sql", "attempt_no").alias("broken_sql"),
        F.max_by("sql", "attempt_no").alias("fixed_sql"),
        F.max_by("ok", "attempt_no").alias("_final_ok"),
        F.min_by("error", "attempt_no").alias("error"),
        F.count_if(F.col("action") == "repairing").alias("_repairs"))
    keep = (F.col("_final_ok") & (F.col("_repairs") > 0)
            & (one_line(F.col("broken_sql")) != one_line(F.col("fixed_sql"))))
    return per.where(keep).select("arm", "question_id", "broken_sql", "error", "fixed_sql")


def calls_delta(calls: DataFrame) -> DataFrame:
    """Calls charged to one answer from a shared running total: the running total
    per run, then total − previous total (lag as an equi-join on seq − 1)."""
    scanned = ordered_scan(calls.select("run_id", "event_id", "ts", "prompt_tokens"),
                           ["run_id"], ["ts", "event_id"], seq="seq",
                           sums={"running_total": F.col("prompt_tokens").cast("long")})
    lagged = previous_value(scanned, ["run_id"], "seq", ["running_total"])
    return lagged.select("run_id", "event_id", "running_total",
                         (F.col("running_total") - F.coalesce("prev_running_total", F.lit(0))).alias("delta"))


def best_round(rounds: DataFrame) -> DataFrame:
    """Evaluate-optimise selection. score = c1+c2+c3+c4 − 10 × schema errors;
    rounds stop at the first passing one (all four criteria 3, no schema error);
    the best is the earliest strict maximum above −1, else the first draft; the
    last round replaces it only if it is schema-clean while the best is < 0.
    All steps are grouped aggregates."""
    r = rounds.withColumn("score", F.col("c1") + F.col("c2") + F.col("c3") + F.col("c4") - 10 * F.col("schema_errors"))
    passes = (F.col("c1") == 3) & (F.col("c2") == 3) & (F.col("c3") == 3) & (F.col("c4") == 3) & (F.col("schema_errors") == 0)
    stop = r.groupBy("question_id").agg(F.min(F.when(passes, F.col("round"))).alias("_stop"))
    cut = r.join(stop, "question_id").where(F.col("_stop").isNull() | (F.col("round") <= F.col("_stop")))
    agg = cut.groupBy("question_id").agg(
        F.max("score").alias("_max"),
        F.max_by("round", F.col("score") * 1000000 - F.col("round")).alias("_best_round"),
        F.min_by("sql", "round").alias("_draft_sql"),
        F.min("round").alias("_first_round"),
        F.max_by(F.struct("round", "sql", "schema_errors"), "round").alias("_last"),
        F.max_by("sql", F.col("score") * 1000000 - F.col("round")).alias("_best_sql"))
    best_score = F.when(F.col("_max") > -1, F.col("_max")).otherwise(F.lit(-1))
    best_round_ = F.when(F.col("_max") > -1, F.col("_best_round")).otherwise(F.col("_first_round"))
    best_sql = F.when(F.col("_max") > -1, F.col("_best_sql")).otherwise(F.col("_draft_sql"))
    use_last = (F.col("_last.schema_errors") == 0) & (best_score < 0)
    return agg.select(
        "question_id", best_score.alias("best_score"),
        F.when(use_last, F.col("_last.round")).otherwise(best_round_).alias("final_round"),
        F.when(use_last, F.col("_last.sql")).otherwise(best_sql).alias("final_sql"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], value_cols: list[str]) -> DataFrame:
    """Last write wins per key: ``max_by(struct(values), struct(order))`` — a
    partial aggregate, no sort."""
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*value_cols), F.struct(*order)).alias("_v"))
    return agg.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols])


def running_accuracy(runs: DataFrame) -> DataFrame:
    """Accuracy of each arm after each completed question (completion order =
    finish time, then question id)."""
    s = ordered_scan(runs.select("arm", "question_id", "finished_at", "correct"),
                     ["arm"], ["finished_at", "question_id"], seq="n_done",
                     sums={"_c": F.col("correct").cast("long")})
    return s.select("arm", "question_id", "n_done",
                    F.round(F.lit(100.0) * F.col("_c") / F.col("n_done"), 4).alias("running_acc"))


def stalls(spans: DataFrame) -> DataFrame:
    """Repeated action signatures within a run.

    repeat  — the signature was seen earlier in the run (first sighting by a
              grouped ``min``);
    stalled — length of the unbroken streak of repeats ending here (a new
              signature resets to 0), by gaps-and-islands: islands start at
              non-repeats, numbered by a running count.
    flagged — stalled ≥ 2."""
    s = spans.select("run_id", "seq", "signature")
    first = s.groupBy("run_id", "signature").agg(F.min("seq").alias("_first"))
    s = s.join(first, ["run_id", "signature"]).withColumn("is_repeat", F.col("seq") > F.col("_first"))
    s = ordered_scan(s, ["run_id"], ["seq"], seq=None, sums={"_island": (~F.col("is_repeat")).cast("long")})
    start = s.groupBy("run_id", "_island").agg(F.min("seq").alias("_start"))
    s = s.join(start, ["run_id", "_island"])
    stalled = (F.col("seq") - F.col("_start")).cast("int")
    return s.select("run_id", "seq", "signature", "is_repeat", stalled.alias("stalled"),
                    (stalled >= 2).alias("flagged"))
