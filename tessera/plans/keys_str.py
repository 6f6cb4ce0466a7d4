"""STR keys: each replays the events as a feed, runs its stream to the end over several
micro-batches and returns the table it wrote; the oracle is the batch answer."""

from pyspark.sql import functions as F

from ..streaming import streams as ST
from .registry import register


def _run(op, spark, d):
    return op(spark, ST.feed(spark, d), ST.scratch(spark, "ck"), ST.scratch(spark, "table"))


@register("str_running_accuracy", """
SELECT event_type AS arm, count(*) AS attempts, round(100.0 * avg(CASE WHEN value >= 30 THEN 1.0 ELSE 0.0 END), 4) AS acc
FROM events GROUP BY event_type""")
def str_running_accuracy(spark, d):
    return _run(ST.running_accuracy, spark, d)


@register("str_windowed_accuracy", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS arm, count(*) AS attempts, count_if(value >= 30) AS ok
FROM events GROUP BY strftime(ts, '%Y-%m-%d'), event_type""")
def str_windowed_accuracy(spark, d):
    return _run(ST.windowed_accuracy, spark, d)


@register("str_session_accuracy", """
WITH e AS (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 12 HOUR THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id AS question_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS attempts, count_if(value >= 30) AS ok
FROM s GROUP BY user_id, n""")
def str_session_accuracy(spark, d):
    return _run(ST.session_accuracy, spark, d)


@register("str_upsert_runs", """
SELECT event_type AS arm, user_id AS question_id, event_id, value >= 30 AS correct FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1""")
def str_upsert_runs(spark, d):
    return _run(ST.upsert_runs, spark, d)


@register("str_dedup_lessons", """
SELECT DISTINCT concat('db', CAST(user_id % 11 AS VARCHAR)) AS scope,
       concat('no such column: c', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 5 AS VARCHAR)) AS error,
       concat(event_type, ' : ', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 4 AS VARCHAR)) AS sql FROM events""")
def str_dedup_lessons(spark, d):
    return _run(ST.dedup_lessons, spark, d)


@register("str_span_pairing", """
SELECT event_id AS span_id, event_type, CASE WHEN value < 300 THEN 'ok' ELSE 'failed' END AS status,
       CASE WHEN value < 300 THEN CAST(round(value * 1000000) AS BIGINT) ELSE -1 END AS duration_us FROM events""")
def str_span_pairing(spark, d):
    return _run(ST.span_pairing, spark, d).withColumn("duration_us", F.coalesce("duration_us", F.lit(-1)))
