"""Driver contract smoke tests and stream-vs-batch twins."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.plans import derived as D
from tessera.streaming import streams as ST

from .conftest import SF001


def test_entry_runs(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 5 and {r.r_name for r in rows}


def test_every_key_has_callable_and_oracle_names(spark):
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 130


def test_stream_upsert_equals_batch(spark, t):
    got = ST.upsert_runs(spark, ST.feed(spark, SF001), ST.scratch(spark, "ck"), ST.scratch(spark, "runs"))
    batch = D.runs(t.events)
    assert got.count() == batch.count()
    j = got.join(batch.select("arm", "question_id", F.col("correct").alias("bc")), ["arm", "question_id"])
    assert j.where(F.col("correct") != F.col("bc")).count() == 0


def test_stream_running_accuracy_equals_batch(spark, t):
    got = {r.arm: (r.attempts, r.acc) for r in ST.running_accuracy(spark, ST.feed(spark, SF001), ST.scratch(spark, "ck"), ST.scratch(spark, "acc")).collect()}
    batch = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                               F.round(F.lit(100.0) * F.avg((F.col("value") >= 30).cast("double")), 4).alias("a"))
    assert got == {r.event_type: (r.n, r.a) for r in batch.collect()}


def test_streams_of_90_unsorted_days_equal_batch(spark, tmp_path):
    # Eight files, each with the events of one time of day over all days.
    n, day = 8 * 90, 86_400_000_000
    events = spark.range(0, n, 1, 8).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("id") * 37 % 90) * day + (F.col("id") / 90).cast("long") * (day // 9)).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 20).alias("user_id"), F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("event_type"), (F.col("id") % 400).cast("double").alias("value"),
        F.lit('{"k": 1}').alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    rows = spark.read.parquet(str(tmp_path / "events.parquet"))
    windows = {(r.day, r.arm): (r.attempts, r.ok) for r in ST.windowed_accuracy(spark, ST.feed(spark, str(tmp_path)), ST.scratch(spark, "ck"), ST.scratch(spark, "win")).collect()}
    batch = rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 30).alias("ok"))
    assert windows == {(r.day, r.event_type): (r.n, r.ok) for r in batch.collect()}
    spans = ST.span_pairing(spark, ST.feed(spark, str(tmp_path)), ST.scratch(spark, "ck"), ST.scratch(spark, "spans")).collect()
    assert sorted((r.span_id, r.status) for r in spans) == [(i, "ok" if i % 400 < 300 else "failed") for i in range(n)]


def test_feed_of_no_events(spark, tmp_path):
    spark.read.parquet(f"{SF001}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert spark.read.parquet(ST.feed(spark, str(tmp_path))).count() == 0
