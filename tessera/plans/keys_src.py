"""SRC/SNK keys: derived run data is written by Spark to the session's
checkpoint folder and read back through the loaders."""

from functools import reduce

from pyspark.sql import functions as F

from ..sources import files as FS
from ..sources.tables import load_tables, tables
from ..streaming.streams import scratch
from . import derived as D
from .derived_sql import QUESTIONS, RUNS, with_
from .keys_misc import _requests
from .keys_pro import COLUMNS
from .registry import register


BOOK_RUNS = 400


def lit(s):
    return "'" + s + "'"


@register("src_tables", " UNION ALL ".join(f"SELECT {lit(t)} AS table_name, count(*) AS n_rows FROM {t}" for t in sorted(COLUMNS)))
def src_tables(spark, d):
    t = load_tables(spark, d, register=True)
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in sorted(t)))


@register("src_questions", with_(QUESTIONS) + """
SELECT CAST(question_id AS INTEGER) AS question_id, db_id, question,
       CASE WHEN question_id % 3 = 0 THEN '' ELSE coalesce(trap, '') END AS evidence, gold_sql,
       CASE WHEN question_id % 5 = 0 THEN 'unknown' ELSE difficulty END AS difficulty FROM questions""")
def src_questions(spark, d):
    t = tables(spark, d)
    q = D.questions(t.events, t.documents)
    path = scratch(spark, "questions")
    q.select(F.col("question_id").cast("string").alias("question_id"), "db_id", "question",
             F.when(F.col("question_id") % 3 == 0, F.lit(None)).otherwise(F.col("trap")).alias("evidence"),
             F.col("gold_sql").alias("SQL"),
             F.when(F.col("question_id") % 5 == 0, F.lit(None)).otherwise(F.col("difficulty")).alias("difficulty")) \
        .write.option("ignoreNullFields", "true").json(path)
    return FS.load_questions(spark, path)


@register("src_runs", with_(RUNS) + """
SELECT arm, CAST(question_id AS VARCHAR) AS question_id, db_id, difficulty, correct, draft_correct, reason, sql, draft_sql,
       CAST(calls AS INTEGER) AS calls, round(seconds, 4) AS seconds, repaired, array_to_string(agents, ',') AS agents,
       true AS memory, CAST(1 AS INTEGER) AS lessons_recalled, false AS lesson_learned FROM runs""")
def src_runs(spark, d):
    t = tables(spark, d)
    runs = D.runs(t.events).withColumn("written_at", F.col("finished_at").cast("timestamp"))
    path = scratch(spark, "runs")
    new = runs.select("arm", F.col("question_id").cast("string").alias("question_id"), "db_id", "difficulty", "correct",
                      "draft_correct", "reason", "sql", "draft_sql", F.col("calls").cast("int").alias("calls"), "seconds",
                      "repaired", "agents", F.lit(True).alias("memory"), F.lit(1).alias("lessons_recalled"),
                      F.lit(False).alias("lesson_learned"), "written_at")
    new.write.json(path + "/part=new")
    # an older writer: no memory columns, earlier timestamps (so the newer rows win)
    new.drop("memory", "lessons_recalled", "lesson_learned", "draft_sql") \
        .withColumn("written_at", F.col("written_at") - F.expr("INTERVAL 1 DAY")).write.json(path + "/part=old")
    spark.createDataFrame([("{not json",)], "value string").write.text(path + "/part=bad")
    return FS.load_runs(spark, path).withColumns({"seconds": F.round("seconds", 4), "agents": F.array_join("agents", ",")}).drop("written_at")


@register("src_notebook_rows", with_(RUNS) + """
SELECT arm, question_id, db_id, difficulty, correct, draft_correct, CAST(calls AS INTEGER) AS calls, round(seconds, 4) AS seconds,
       repaired, array_to_string(agents, ',') AS agents, '' AS sql, '' AS draft_sql, 'recovered from notebook output' AS reason FROM runs""")
def src_notebook_rows(spark, d):
    """Notebooks written from the runs, a bounded number in each, and recovered. The
    printed SQL holds brackets, commas, quotes and fields of its own."""
    runs = D.runs(tables(spark, d).events)
    books = -(-runs.count() // BOOK_RUNS) or 1
    flag = lambda c: F.when(F.col(c), "True").otherwise("False")
    printed = F.concat(F.lit("('"), "arm", F.lit("', "), F.col("question_id").cast("string"), F.lit("): Row(strategy='"), "arm", F.lit("', question_id="),
                       F.col("question_id").cast("string"), F.lit(", db_id='"), "db_id", F.lit("', difficulty='"), "difficulty", F.lit("', correct="), flag("correct"),
                       F.lit(", draft_correct="), flag("draft_correct"), F.lit(", calls="), F.col("calls").cast("string"), F.lit(", seconds="),
                       F.format_string("%.6f", F.col("seconds")), F.lit(", repaired="), flag("repaired"), F.lit(", agents=['"), F.array_join("agents", "', '"), F.lit("'], sql=\"SELECT f(x), 'a' FROM Row(correct=None), t\")"))
    book = F.pmod(F.xxhash64("arm", "question_id"), F.lit(books))
    cell = runs.select("arm", "question_id", printed.alias("row")).groupBy(book.alias("book"), "arm").agg(
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("row")), ",\n "), F.lit("}")).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.lit("\n")))
    shown = F.struct(F.lit("code").alias("cell_type"), F.array(
        F.struct(F.lit("stream").alias("output_type"), F.struct(F.array(F.lit("Row(strategy='no'),")).alias("text/plain")).alias("data")),
        F.struct(F.lit("execute_result").alias("output_type"), F.struct(lines.alias("text/plain")).alias("data"))).alias("outputs"))
    written = cell.groupBy("book").agg(F.to_json(F.struct(F.collect_list(shown).alias("cells"))).alias("value"))
    path = scratch(spark, "notebooks")
    written.repartition("book").write.partitionBy("book").option("lineSep", "\n").text(path)
    return FS.recover_rows(spark, path).withColumns({"seconds": F.round("seconds", 4), "agents": F.array_join("agents", ",")}).drop("complete")


@register("src_lessons", """
SELECT doc_id AS seq, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS db_id, text AS question, 'SELECT 1' AS broken_sql,
       concat('error in ', source) AS error, 'SELECT 2' AS fixed_sql FROM documents""")
def src_lessons(spark, d):
    t = tables(spark, d)
    docs = t.documents.select(F.col("doc_id").alias("seq"),
                              F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("db_id"),
                              F.col("text").alias("question"), F.lit("SELECT 1").alias("broken_sql"),
                              F.concat(F.lit("error in "), F.col("source")).alias("error"), F.lit("SELECT 2").alias("fixed_sql"))
    path = scratch(spark, "lessons")
    docs.write.option("ignoreNullFields", "true").json(path)
    return FS.load_lessons(spark, path).drop("recorded_at")


@register("src_discover", " UNION ALL ".join(f"SELECT {lit(t)} AS id, count(*) AS n_rows FROM {t}" for t in sorted(COLUMNS)))
def src_discover(spark, d):
    """Dataset files under the folder by their ids, each read and counted."""
    found = FS.discover_tables(spark, d)
    parts = [spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).alias("id"), "n_rows") for i, path in found]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("snk_runs", with_(RUNS) + "SELECT arm, question_id, correct, calls FROM runs WHERE correct")
def snk_runs(spark, d):
    runs = D.runs(tables(spark, d).events).select("arm", "question_id", "correct", "calls")
    path = scratch(spark, "runlog")
    FS.save_runs(runs, path)
    FS.save_runs(runs.where(F.col("correct")), path)  # replaced, not appended
    return spark.read.schema(runs.schema).json(FS.current(spark, path))


@register("snk_backup_once", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def snk_backup_once(spark, d):
    o = tables(spark, d).orders.select("o_orderkey", "o_orderstatus")
    path, backup = scratch(spark, "table"), scratch(spark, "backup")
    FS.publish(o, path, "parquet")
    FS.write_with_backup(o.where(F.col("o_orderstatus") == "F"), path, backup)
    FS.write_with_backup(o.where(F.col("o_orderstatus") == "O"), path, backup)  # backup kept from the first change
    return spark.read.parquet(FS.current(spark, backup)).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("snk_sharded", """
SELECT substr(key, 1, 2) AS shard, count(*) AS entries FROM (
  SELECT sha256(concat('{"model":"', event_type, '","schema":"none","system":"sql-writer","temperature":',
         CAST(CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 5 = 0 THEN 0.7 ELSE 0.0 END AS VARCHAR),
         ',"user":"q', CAST(user_id AS VARCHAR), '"}')) AS key FROM events) k GROUP BY substr(key, 1, 2)""")
def snk_sharded(spark, d):
    reqs = _requests(spark, d).select("key", "response")
    path = scratch(spark, "cache")
    FS.write_cache(reqs, path)
    return spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("entries"))
