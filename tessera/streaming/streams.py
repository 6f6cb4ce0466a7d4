"""STR — live versions of progress, windowed accuracy, upserts, dedup and span pairing.

Source: ``readStream`` over a feed of event files (schema given, never inferred); the
keys replay the events table as such a feed, in time order and several files, so state
is carried over several micro-batches. Event time is cast to TIMESTAMP (Spark refuses
TIMESTAMP_NTZ as a watermark column). Every query takes a checkpoint location, so a
restarted query resumes where it stopped; ``trigger(availableNow=True)`` drains what
is there and stops. Results are written as tables, never kept in the driver: a Parquet
sink for what is final, a keyed table (``sources.keyed``) for what changes, a versioned
table for the few rows of a complete result.

A feed ends with a heartbeat: a row without an event, later than all events by more than
any lateness, as an idle source would send. It moves the watermark on, so windows,
sessions and spans that are open at the end are closed by the stream itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..session import ensure_checkpoint_dir
from ..sources.keyed import KeyedTable
from ..sources.versions import current, publish
from .spans import GROUPS, SPAN_SCHEMA, SpanStates

FEED_PARTS = 4
FILE_ROWS = 1_000_000  # of the feed; a micro-batch reads one file
LATENESS_DAYS = 10
# Two neighbouring stretches fit the lateness, so even files of one modification time may be swapped.
STRETCH_US = LATENESS_DAYS * 86_400_000_000 // 2 - 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (shared on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def feed(spark: SparkSession, sf_dir: str, parts: int = FEED_PARTS) -> str:
    """The events table written as a feed: at least ``parts`` consecutive stretches of
    time, each no longer than ``STRETCH_US``, one after the other, so that a file source
    reads them in that order. Files of one stretch come in any order, and stay within the
    streams' lateness however long the events last."""
    events, path, staged = spark.read.parquet(f"{sf_dir}/events.parquet"), scratch(spark, "feed"), scratch(spark, "stretches")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    lo, hi = span.lo or 0, span.hi or 0
    width = max(1, min(-(-(hi - lo + 1) // parts), STRETCH_US))
    stretch = F.coalesce(F.floor((at - lo) / F.lit(width)), F.lit(0)).cast("long")
    dealt = events.withColumn("feed_stretch", stretch)
    dealt.repartitionByRange("feed_stretch", "ts").write.partitionBy("feed_stretch").parquet(staged)
    events.limit(0).write.parquet(path)
    for r in spark.read.schema(dealt.schema).parquet(staged).groupBy("feed_stretch").count().orderBy("feed_stretch").collect():  # stretches with events
        rows = spark.read.schema(events.schema).parquet(f"{staged}/feed_stretch={r.feed_stretch}")
        rows.coalesce(-(-r["count"] // FILE_ROWS)).write.mode("append").parquet(path)
    heartbeat(events, path)
    return path


def heartbeat(events: DataFrame, feed_dir: str) -> None:
    """Append a row that has no event, only a time after all lateness and timeouts."""
    last = events.agg((F.max("ts") + F.make_interval(days=F.lit(2 * LATENESS_DAYS))).alias("ts")).where("ts IS NOT NULL")
    none = [F.col("ts").cast(f.dataType).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    last.select(*none).coalesce(1).write.mode("append").parquet(feed_dir)


def events_stream(spark: SparkSession, feed_dir: str, max_files: int = 1, lateness: str | None = None) -> DataFrame:
    """The feed's events; with ``lateness`` under a watermark, which heartbeats move."""
    schema = spark.read.parquet(feed_dir).schema
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(feed_dir)
         .withColumn("ts", F.col("ts").cast("timestamp")))
    if lateness is None:
        return s.where("event_id IS NOT NULL")
    # the condition names ts, so that it is not moved below the watermark, which would miss the heartbeats
    return s.withWatermark("ts", lateness).where("event_id IS NOT NULL OR ts IS NULL")


def _run(df: DataFrame, mode: str, checkpoint: str, each) -> None:
    q = (df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _append(df: DataFrame, checkpoint: str, table_dir: str) -> None:
    q = (df.writeStream.outputMode("append").format("parquet").option("path", table_dir)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _upsert(df: DataFrame, mode: str, checkpoint: str, table: KeyedTable) -> DataFrame:
    """Run a stream into a keyed table, each epoch once, and return the table's rows."""
    def each(batch: DataFrame, epoch: int) -> None:
        table.upsert(batch, checkpoint, epoch)
        table.compact()

    _run(df, mode, checkpoint, each)
    return table.rows()


def running_accuracy(spark: SparkSession, feed_dir: str, checkpoint: str, table_dir: str) -> DataFrame:
    """Live accuracy of attempts per arm (complete mode: one row per arm each time)."""
    agg = events_stream(spark, feed_dir).groupBy(F.col("event_type").alias("arm")).agg(
        F.count(F.lit(1)).alias("attempts"), F.round(F.lit(100.0) * F.avg((F.col("value") >= 30).cast("double")), 4).alias("acc"))
    _run(agg, "complete", checkpoint, lambda batch, epoch: publish(batch, table_dir, "parquet"))
    return spark.read.parquet(current(spark, table_dir))


def windowed_accuracy(spark: SparkSession, feed_dir: str, checkpoint: str, table_dir: str, window: str = "1 day",
                      lateness: str = f"{LATENESS_DAYS} days") -> DataFrame:
    """Per tumbling event-time window and arm, with a lateness bound. Update mode:
    every change of a window is merged into the table, so windows that are still open
    are there too."""
    s = events_stream(spark, feed_dir, lateness=lateness)
    agg = s.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("arm")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("value") >= 30).alias("ok"))
    rows = agg.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "arm", "attempts", "ok")
    return _upsert(rows, "update", checkpoint, KeyedTable(spark, table_dir, ["day", "arm"], ["attempts"], ["attempts", "ok"]))


def session_accuracy(spark: SparkSession, feed_dir: str, checkpoint: str, table_dir: str, gap: str = "12 hours",
                     lateness: str = f"{LATENESS_DAYS} days") -> DataFrame:
    """Per question and session: attempts no more than ``gap`` apart. A session is appended
    once, when the watermark has passed its end, and its state is dropped."""
    s = events_stream(spark, feed_dir, lateness=lateness)
    agg = s.groupBy(F.session_window("ts", gap).alias("w"), F.col("user_id").alias("question_id")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("value") >= 30).alias("ok"))
    rows = agg.select("question_id", F.unix_micros("w.start").alias("start_us"), "attempts", "ok")
    _append(rows, checkpoint, table_dir)
    return spark.read.schema(rows.schema).parquet(table_dir)


def upsert_runs(spark: SparkSession, feed_dir: str, checkpoint: str, table_dir: str) -> DataFrame:
    """Last-write-wins run table: what a micro-batch changes is written as a delta of the
    keyed table, whatever the table holds already."""
    s = events_stream(spark, feed_dir).select(F.col("event_type").alias("arm"), F.col("user_id").alias("question_id"),
                                              "ts", "event_id", (F.col("value") >= 30).alias("correct"))
    table = KeyedTable(spark, table_dir, ["arm", "question_id"], ["ts", "event_id"], ["correct"])
    return _upsert(s, "append", checkpoint, table).select("arm", "question_id", "event_id", "correct")


def dedup_lessons(spark: SparkSession, feed_dir: str, checkpoint: str, table_dir: str) -> DataFrame:
    """Admit each (scope, error, folded SQL) once ever: the state holds the admitted
    keys, as the lesson store itself does."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    lessons = events_stream(spark, feed_dir).select(
        F.concat(F.lit("db"), (F.col("user_id") % 11).cast("string")).alias("scope"),
        F.concat(F.lit("no such column: c"), (k % 5).cast("string")).alias("error"),
        one_line(F.concat(F.col("event_type"), F.lit(" :  "), (k % 4).cast("string"))).alias("sql"))
    _append(lessons.dropDuplicates(["scope", "error", "sql"]), checkpoint, table_dir)
    return spark.read.parquet(table_dir)


def span_events(spark: SparkSession, feed_dir: str, timeout_s: int = 300, lateness: str = f"{LATENESS_DAYS} days") -> DataFrame:
    """``span_id, event_type, us`` (when) and ``closes`` of the feed's span events: every
    event opens a span, and one of a value under the timeout closes it so much later."""
    s = events_stream(spark, feed_dir, lateness=lateness)
    opened = F.struct(F.unix_micros("ts").alias("us"), F.lit(False).alias("closes"))
    closed = F.struct(F.unix_micros(F.col("ts") + F.make_interval(secs=F.col("value"))).alias("us"), F.lit(True).alias("closes"))
    both = F.when(F.col("value") < timeout_s, F.array(opened, closed)).otherwise(F.array(opened))
    return s.select("ts", F.col("event_id").alias("span_id"), "event_type", F.explode(both).alias("e")).select("ts", "span_id", "event_type", "e.us", "e.closes")


def pair_spans(events: DataFrame, checkpoint: str, table_dir: str, timeout_s: int = 300) -> DataFrame:
    """Spans from a watermarked stream of ``span_events``, a state machine for each
    (:class:`spans.SpanStates`), appended to a table as they close or expire."""
    spark, conf = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    grouped = events.withColumn("span_group", F.pmod(F.xxhash64("span_id"), F.lit(GROUPS)))
    out = grouped.groupBy("span_group").transformWithStateInPandas(SpanStates(timeout_s), SPAN_SCHEMA, "append", "eventTime")
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        _append(out, checkpoint, table_dir)
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)
    return spark.read.schema(SPAN_SCHEMA).parquet(table_dir)


def span_pairing(spark: SparkSession, feed_dir: str, checkpoint: str, table_dir: str, timeout_s: int = 300,
                 lateness: str = f"{LATENESS_DAYS} days") -> DataFrame:
    """Pair span-open and span-close events into durations; a span that is not closed
    within ``timeout_s`` fails by its timer, inside the stream."""
    return pair_spans(span_events(spark, feed_dir, timeout_s, lateness), checkpoint, table_dir, timeout_s)
