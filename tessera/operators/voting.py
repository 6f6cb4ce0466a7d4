"""VOT — majority answer, review quorum, rubric scoring, feedback routing.

All per-question decisions are grouped aggregates: ``max_by`` over a struct
picks a winner without a sort, and per-question lists are bounded by the
number of samples / reviewers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rubric criteria in their fixed order, and the pass mark.
CRITERIA = ("correctness", "completeness", "schema_fit", "clarity")
PASS_MARK = 3


def majority(samples: DataFrame) -> DataFrame:
    """samples(question_id, sample_no, sql, ok, fingerprint). Failed samples do
    not vote; the biggest answer group wins, ties to the earliest sample; its
    first SQL is returned. If nobody ran, the first draft with agreement 0."""
    groups = (samples.where(F.col("ok")).groupBy("question_id", "fingerprint")
              .agg(F.count(F.lit(1)).alias("votes"), F.min("sample_no").alias("first"),
                   F.min_by("sql", "sample_no").alias("sql")))
    win = groups.groupBy("question_id").agg(
        F.max_by(F.struct("votes", "sql", "fingerprint"), F.struct(F.col("votes"), -F.col("first"))).alias("w"),
        F.count(F.lit(1)).alias("distinct_answers"))
    per_q = samples.groupBy("question_id").agg(F.count(F.lit(1)).alias("samples"),
                                               F.min_by("sql", "sample_no").alias("first_draft"))
    j = per_q.join(win, "question_id", "left")
    return j.select("question_id", "samples",
                    F.coalesce("w.sql", "first_draft").alias("sql"),
                    F.coalesce("w.votes", F.lit(0)).alias("agreement"),
                    F.coalesce("distinct_answers", F.lit(0)).alias("distinct_answers"),
                    (F.coalesce("distinct_answers", F.lit(0)) == 1).alias("unanimous"))


def quorum(votes: DataFrame, schema_errors: DataFrame, need: int = 2, decisive: bool = False) -> DataFrame:
    """votes(question_id, reviewer, focus, approved, issue); schema_errors(question_id, n).
    An objection is a vote neither approved nor silent (non-empty issue); a
    missing vote (NULL) is ignored. Schema errors replace the vote: with
    ``decisive=False`` (the reference's behaviour) they count against the same
    threshold, so one alone triggers no repair; ``decisive=True`` repairs on any."""
    objecting = F.col("approved").isNotNull() & ~F.col("approved") & (F.trim(F.coalesce("issue", F.lit(""))) != "")
    per = votes.groupBy("question_id").agg(
        F.count_if(objecting).alias("objections"),
        F.array_join(F.sort_array(F.collect_list(F.when(objecting, F.concat(F.col("focus"), F.lit(": "), F.col("issue"))))),
                     "; ").alias("issues"))
    j = per.join(schema_errors, "question_id", "left").withColumn("schema_errors", F.coalesce("n", F.lit(0))).drop("n")
    total = F.col("objections") + F.col("schema_errors")
    repair = (total >= need) | (F.col("schema_errors") > 0) if decisive else (total >= need)
    return j.select("question_id", "objections", "schema_errors", repair.alias("repair"), "issues")


def rubric(df: DataFrame, cols=("c1", "c2", "c3", "c4")) -> DataFrame:
    """Total, weakest criterion (first minimum in fixed order), pass only if all are 3."""
    lo = F.least(*[F.col(c) for c in cols])
    weakest = None
    for c, name in zip(cols, CRITERIA):
        weakest = F.when(F.col(c) == lo, name) if weakest is None else weakest.when(F.col(c) == lo, name)
    passes = None
    for c in cols:
        cond = F.col(c) == PASS_MARK
        passes = cond if passes is None else passes & cond
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return df.select("question_id", "round", total.alias("total"), weakest.alias("weakest"), passes.alias("passes"))


def review(df: DataFrame) -> DataFrame:
    """df(schema_errors, has_critique, issue): clean = no schema errors and (no
    critique, or a critique with no issue); feedback assembled in sections."""
    clean = (F.col("schema_errors") == 0) & (~F.col("has_critique") | F.col("issue").isNull())
    feedback = F.concat_ws("\n",
                           F.when(F.col("schema_errors") > 0,
                                  F.concat(F.lit("Schema errors: "), F.col("schema_errors").cast("string"))),
                           F.when(F.col("has_critique") & F.col("issue").isNotNull(),
                                  F.concat(F.lit("Reviewer: "), F.col("issue"))))
    return df.select("question_id", "round", clean.alias("clean"), feedback.alias("feedback"))


def schema_hints(problems: DataFrame) -> DataFrame:
    """``check_refs`` problems → (query_id, hint): one line per problem, in order; a
    query has as many as it has references."""
    line = F.concat(F.lit("Schema: "), "problem", F.lit(" "), "name", F.when(F.col("detail") != "", F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise(F.lit("")))
    return problems.select("query_id", line.alias("line")).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("hint"))


def feedback(attempts: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """attempts(arm, question_id, attempt_no, ok, error, mode, review_clean, review_text).
    none → nothing; a failure → the database error plus a hint and, if ``hints``
    (arm, question_id, attempt_no, hint) holds any, what the schema says (execution and
    both); a success → the review's feedback only if it is not clean
    (critique and both); otherwise nothing."""
    uses_exec = F.col("mode").isin("execution", "both")
    uses_crit = F.col("mode").isin("critique", "both")
    key = ["arm", "question_id", "attempt_no"]
    attempts = attempts.withColumn("hint", F.lit(None).cast("string")) if hints is None else attempts.join(hints, key, "left")
    fb = (F.when(F.col("mode") == "none", F.lit(None))
          .when(~F.col("ok") & uses_exec,
                F.concat_ws("\n", F.concat(F.lit("The query failed: "), F.col("error")), F.lit("Hint: check table and column names."), F.col("hint")))
          .when(F.col("ok") & uses_crit & ~F.col("review_clean"), F.col("review_text")))
    return attempts.select("arm", "question_id", "attempt_no", fb.alias("feedback"))
