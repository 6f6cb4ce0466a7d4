"""Substrates derived from the driver's test tables.

The harness works on run logs, attempts, spans, votes and rounds; the test
data has none, so they are derived here with the same rules as the oracle
CTEs in ``derived_sql``. Everything is lazy and grows with the input tables.

Fixed values of the derivation (they must match the oracle side):
  baseline arm ............ view
  equal-cost control arm .. click
  repair mode by arm ...... error=none, click=execution, purchase=critique, signup=both, view=direct
  difficulty by user_id%10  0-2 simple, 3-7 moderate, 8-9 challenging
  database id ............. 'db' || user_id % 11
  model size by user_id%3 . 0 '1.5B', 1 '3B', 2 '7B'
  attempt ok .............. value >= 30
  span run bucket ......... 6 days (518400 s)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line
from .ordered import ordered_scan

BASELINE_ARM = "view"
CONTROL_ARM = "click"
MODE_BY_ARM = {"error": "none", "click": "execution", "purchase": "critique", "signup": "both", "view": "direct"}
SIZES = ("1.5B", "3B", "7B")
RUN_BUCKET_SECONDS = 518400


def k_of(props: Column) -> Column:
    """The integer ``k`` inside ``props`` (``{"k": n}``)."""
    return F.regexp_extract(props, "([0-9]+)", 1).cast("int")


def difficulty_of(qid: Column) -> Column:
    m = qid % 10
    return F.when(m < 3, "simple").when(m < 8, "moderate").otherwise("challenging")


def db_of(qid: Column) -> Column:
    return F.concat(F.lit("db"), (qid % 11).cast("string"))


def size_of(qid: Column) -> Column:
    m = qid % 3
    return F.when(m == 0, SIZES[0]).when(m == 1, SIZES[1]).otherwise(SIZES[2])


def mode_of(arm: Column) -> Column:
    expr = None
    for a, m in MODE_BY_ARM.items():
        expr = (F.when(arm == a, m) if expr is None else expr.when(arm == a, m))
    return expr.otherwise("direct")


def error_of(ok: Column, k: Column) -> Column:
    return F.when(ok, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("no such column: c"), (k % 5).cast("string")))


def tries(events: DataFrame) -> DataFrame:
    """One row per try, unnumbered: arm = event type, question = user; a question's
    tries are ordered by (ts, event_id)."""
    e = events.select(
        F.col("event_type").alias("arm"), F.col("user_id").alias("question_id"),
        "event_id", "ts", (F.col("value") >= 30).alias("ok"), F.col("value").alias("seconds"),
        k_of(F.col("props")).alias("k"))
    return (e.withColumn("difficulty", difficulty_of(F.col("question_id")))
         .withColumn("db_id", db_of(F.col("question_id")))
         .withColumn("sql", F.concat(F.col("arm"), F.lit(":"), (F.col("k") % 4).cast("string")))
            .withColumn("error", error_of(F.col("ok"), F.col("k"))))


def attempts(events: DataFrame) -> DataFrame:
    """Tries numbered 1, 2, … within their (arm, question)."""
    return ordered_scan(tries(events), ["arm", "question_id"], ["ts", "event_id"], seq="attempt_no")


def runs_from_attempts(att: DataFrame) -> DataFrame:
    """One row per (arm, question): draft = first try, final = last. Works on tries
    as on numbered attempts: only their order is used.

    ``min_by``/``max_by`` are partial aggregates: no sort, no window, and a hot
    question is combined map-side before the shuffle."""
    r = att.groupBy("arm", "question_id", "difficulty", "db_id").agg(
        F.min_by("ok", F.struct("ts", "event_id")).alias("draft_correct"),
        F.max_by("ok", F.struct("ts", "event_id")).alias("correct"),
        F.min_by("sql", F.struct("ts", "event_id")).alias("draft_sql"),
        F.max_by("sql", F.struct("ts", "event_id")).alias("sql"),
        F.max_by("k", F.struct("ts", "event_id")).alias("last_k"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("seconds").alias("seconds"),
        F.max("ts").alias("finished_at"),
        F.sort_array(F.collect_set(agent_of(F.col("k")))).alias("agents"))
    lk = F.col("last_k") % 4
    reason = (F.when(F.col("correct"), "match")
              .when(lk == 0, F.concat(F.lit("crashed: worker timed out while grading question group "),
                                      (F.col("question_id") % 7).cast("string")))
              .when(lk == 1, F.concat(F.lit("query failed to execute: no such column: c"),
                                      (F.col("last_k") % 5).cast("string")))
              .when(lk == 2, "row count differs")
              .otherwise("same row count, different values"))
    return (r.withColumn("repaired", F.col("calls") > 1)
            .withColumn("reason", reason)
            .withColumn("mode", mode_of(F.col("arm")))
            .withColumn("model_size", size_of(F.col("question_id"))))


def agent_of(k: Column) -> Column:
    m = k % 3
    return F.when(m == 0, "writer").when(m == 1, "critic").otherwise("fixer")


def runs(events: DataFrame) -> DataFrame:
    return runs_from_attempts(tries(events))


def questions(events: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per question (user): strata, database and the question text
    (the whole document with the same id, folded to one line)."""
    q = events.select(F.col("user_id").alias("question_id")).distinct()
    docs = documents.select(F.col("doc_id").alias("question_id"),
                            one_line(F.col("text")).alias("question"))
    return (q.join(docs, "question_id", "left")
            .select("question_id",
                    F.coalesce("question", F.lit("")).alias("question"),
                    difficulty_of(F.col("question_id")).alias("difficulty"),
                    db_of(F.col("question_id")).alias("db_id"),
                    F.concat(F.lit("gold:"), (F.col("question_id") % 4).cast("string")).alias("gold_sql"),
                    F.when(F.col("question_id") % 7 == 0, "self_reference")
                    .when(F.col("question_id") % 7 == 1, "nullable_reference").alias("trap")))


def chains(att: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Bounded attempt chains: the first ``max_attempts`` tries per question.

    Each group now holds at most ``max_attempts`` rows, so windows over it are
    bounded no matter how hot the question is."""
    return att.where(F.col("attempt_no") <= max_attempts)


def span_log(events: DataFrame) -> DataFrame:
    """Flat span log, unnumbered: run = (user, 6-day bucket)."""
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / RUN_BUCKET_SECONDS)
    s = events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), bucket.cast("string")).alias("run_id"),
        F.col("event_id").alias("span_id"), "ts",
        F.col("event_type").alias("agent"), F.col("value").alias("elapsed"),
        F.when(F.col("value") >= 30, "ok").otherwise("failed").alias("status"),
        k_of(F.col("props")).alias("k"))
    return s.withColumn("signature", F.concat(F.col("agent"), F.lit("|"), (F.col("k") % 3).cast("string")))


def _numbered(log: DataFrame) -> DataFrame:
    s = ordered_scan(log, ["run_id"], ["ts", "span_id"], seq="seq")
    return s.withColumn("parent_seq", (F.col("seq") / 2).cast("int"))


def spans(events: DataFrame) -> DataFrame:
    """Spans numbered by (ts, event_id) within their run; parent = seq // 2 (a
    deterministic tree, seq 1 is the root)."""
    return _numbered(span_log(events))


def span_tree(events: DataFrame) -> DataFrame:
    """``run_id, seq, parent_seq`` of ``spans``, with no other column dealt or frozen."""
    return _numbered(span_log(events).select("run_id", "span_id", "ts")).select("run_id", "seq", "parent_seq")


def calls_log(events: DataFrame) -> DataFrame:
    """One model call per event: model = event type, tokens = k."""
    k = k_of(F.col("props"))
    return events.select(
        F.col("user_id").alias("run_id"), "event_id", "ts",
        F.col("event_type").alias("model"),
        (k % 3 == 0).alias("cached"),
        k.alias("prompt_tokens"), (k % 10).alias("completion_tokens"),
        F.col("value").alias("seconds"),
        F.when(k % 5 == 0, F.lit(0.7)).otherwise(F.lit(0.0)).alias("temperature"))


def rounds(lineitem: DataFrame) -> DataFrame:
    """Evaluate-optimise rounds from line items: question = order, round = line
    number (latest line per (order, line number)); criteria scored 0-3."""
    latest = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.max_by(F.struct("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_partkey"),
                 F.struct("l_shipdate", "l_partkey", "l_suppkey")).alias("x"))
    return latest.select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("round"),
        (F.col("x.l_quantity").cast("int") % 4).alias("c1"),
        (F.col("l_linenumber") % 4).alias("c2"),
        (F.round(F.col("x.l_discount") * 100).cast("int") % 4).alias("c3"),
        (F.round(F.col("x.l_tax") * 100).cast("int") % 4).alias("c4"),
        F.when(F.col("x.l_returnflag") == "R", 1).otherwise(0).alias("schema_errors"),
        F.concat(F.lit("q"), F.col("l_orderkey").cast("string"), F.lit(":"),
                 F.col("x.l_partkey").cast("string")).alias("sql"))


def regrade_input(runs_df: DataFrame, questions_df: DataFrame) -> DataFrame:
    """Stored grades plus new ones: a grade is right when the answer's variant
    (text after ':') equals the gold variant. Fixed values: drafts of questions
    with id % 17 = 0 are partial (draft SQL ''); questions with id % 19 = 0 have
    no gold and are skipped."""
    gold = questions_df.where(F.col("question_id") % 19 != 0).select("question_id", "gold_sql")
    r = runs_df.select("arm", "question_id", "correct", "draft_correct", "sql",
                       F.when(F.col("question_id") % 17 == 0, F.lit("")).otherwise(F.col("draft_sql")).alias("draft_sql"))
    j = r.join(gold, "question_id", "left")
    variant = lambda c: F.substring_index(c, ":", -1)
    return j.select(
        "arm", "question_id", "correct", "draft_correct",
        F.col("gold_sql").isNull().alias("skipped"),
        (F.col("draft_sql") == "").alias("ungradable"),
        F.coalesce(variant(F.col("sql")) == variant(F.col("gold_sql")), F.lit(False)).alias("final_now"),
        F.coalesce((F.col("draft_sql") != "") & (variant(F.col("draft_sql")) == variant(F.col("gold_sql"))),
                   F.lit(False)).alias("draft_now"))


# Query-log templates. Placeholders are filled from one `part`
# row; template index = p_partkey % len(QUERY_TEMPLATES).
QUERY_TEMPLATES = [
    "SELECT p_name FROM part WHERE p_brand = '{brand}'",
    "SELECT p_type, count(*) FROM part WHERE p_size > {size} GROUP BY p_type ORDER BY 2 DESC",
    "SELECT c.c_name, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > {size}00",
    "SELECT p_name FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > {size})",
    "SELECT n.n_name, avg(c.c_acctbal) FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name HAVING avg(c.c_acctbal) > {size}",
    "SELECT p_name, rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) FROM part WHERE p_type = '{type}'",
    "SELECT e.p_name, m.p_name FROM part e JOIN part m ON e.p_size = m.p_size WHERE e.p_brand = '{brand}'",
    "SELECT sum(l_extendedprice * (1 - l_discount)) / count(*) FROM lineitem WHERE l_partkey = {key}",
    "SELECT CASE WHEN p_size > {size} THEN 'big' ELSE 'small' END, count(*) FROM part GROUP BY 1",
    "DELETE FROM part WHERE p_brand = '{brand}'",
    "SELECT p_name FROM part; DROP TABLE part",
    "-- list parts\nSELECT p_name /* all of them */ FROM part WHERE p_name LIKE '%{name}%'",
    "UPDATE part SET p_size = {size} WHERE p_partkey = {key}",
    "SELECT load_extension('x') FROM part WHERE p_partkey = {key}",
    "   ",
    "WITH t AS (SELECT p_type, sum(p_retailprice) AS s FROM part GROUP BY p_type) SELECT p_type FROM t WHERE s > {size} ORDER BY s",
    "PRAGMA table_info(part)",
    "SELECT p_name FROM part WHERE p_name = 'it''s {name}; -- ORDER BY' AND p_size IN (SELECT max(p_size) FROM parts)",
]


def query_log(spark, part: DataFrame) -> DataFrame:
    """REL-style templates × values from ``part``: one SQL text per part."""
    tpl = spark.createDataFrame(list(enumerate(QUERY_TEMPLATES)), "tpl_id int, tpl string")
    p = part.select("p_partkey", "p_brand", "p_type", "p_size", "p_name",
                    (F.col("p_partkey") % len(QUERY_TEMPLATES)).cast("int").alias("tpl_id"))
    j = p.join(F.broadcast(tpl), "tpl_id")
    sql = F.col("tpl")
    for ph, val in (("{brand}", F.col("p_brand")), ("{size}", F.col("p_size").cast("string")),
                    ("{type}", F.col("p_type")), ("{name}", F.col("p_name")),
                    ("{key}", F.col("p_partkey").cast("string"))):
        sql = F.replace(sql, F.lit(ph), val)
    return j.select(F.col("p_partkey").alias("query_id"), "tpl_id", sql.alias("sql"))


def votes(lineitem: DataFrame) -> DataFrame:
    """Reviewer votes from line items: question = order, reviewer = line number
    (latest line per (order, line number)); approved when quantity > 25; a
    missing vote (NULL) for open lines under 5 units; silent when flag N."""
    latest = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.max_by(F.struct("l_quantity", "l_returnflag", "l_linestatus", "l_discount"),
                 F.struct("l_shipdate", "l_partkey", "l_suppkey")).alias("x"))
    q = F.col("x.l_quantity")
    approved = F.when((F.col("x.l_linestatus") == "O") & (q < 5), F.lit(None).cast("boolean")).otherwise(q > 25)
    issue = (F.when(q > 25, F.lit("")).when(F.col("x.l_returnflag") == "N", F.lit(""))
             .otherwise(F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" total looks wrong"))))
    focus = F.when(F.col("l_linenumber") % 3 == 0, "joins").when(F.col("l_linenumber") % 3 == 1, "filters").otherwise("aggregates")
    return latest.select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("reviewer"),
                         focus.alias("focus"), approved.alias("approved"), issue.alias("issue"),
                         (F.col("x.l_discount") == 0).alias("_schema_error"))


def replies(conversations: DataFrame) -> DataFrame:
    """Model replies: conversation text wrapped by a template chosen by turn % 6."""
    t, m = F.col("text"), F.col("turn") % 6
    reply = (F.when(m == 0, F.concat(F.lit("```sql\n"), t, F.lit("\n```")))
             .when(m == 1, F.concat(F.lit("SQL: "), t))
             .when(m == 2, F.concat(F.lit("Query:"), t))
             .when(m == 3, F.concat(F.lit(" \n"), t, F.lit("\n ")))
             .when(m == 4, F.concat(F.lit('Here you go: {"score": '), F.col("turn").cast("string"), F.lit(', "note": "ok"} thanks')))
             .otherwise(t))
    return conversations.select("conv_id", "turn", "role", "text", reply.alias("reply"))
