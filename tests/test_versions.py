"""Compare-and-set commits, keyed delta tables, and the streams that use them."""

import os
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import files as FS
from tessera.sources import versions as V
from tessera.sources.keyed import KeyedTable
from tessera.streaming import streams as ST


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_a_commit_names_the_version_it_was_built_on(spark, tmp_path):
    log = V.VersionLog(spark, str(tmp_path / "t"))
    assert log.head() == V.Version()
    assert log.commit(0, {"x": 1}, []).number == 1
    with pytest.raises(V.Conflict):
        log.commit(0, {"x": 2}, [])
    with pytest.raises(V.Conflict):
        V.VersionLog(spark, str(tmp_path / "none")).commit(3, {}, [])
    assert log.commit(1, {"x": "ü" * 50_000}, [], "more").number == 2
    assert log.head().state == {"x": "ü" * 50_000} and log.head().op == "more" and log.read(1).state == {"x": 1}
    assert not [f for f in os.listdir(tmp_path / "t/_log") if f.endswith(".tmp")]


def test_a_taken_name_is_never_overwritten(spark, tmp_path):
    """The last step of a commit, for the case that another writer got there first."""
    log = V.VersionLog(spark, str(tmp_path / "t"))
    log.commit(0, "first", [])
    for name in (log._name, log._rename):
        (tmp_path / "late").write_text("{}")
        with pytest.raises(Exception):
            name(log._path(str(tmp_path / "late")), log._path(f"{log.path}/_log/{1:012d}"))
        assert log.head().state == "first"
    log._rename(log._path(str(tmp_path / "late")), log._path(str(tmp_path / "new")))
    assert os.path.exists(tmp_path / "new")


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    V.publish(spark.range(1), path, "parquet")
    base = V.VersionLog(spark, path).head().number
    V.publish(spark.range(2), path, "parquet", base)
    with pytest.raises(V.Conflict):  # built on the version before
        V.publish(spark.range(3), path, "parquet", base)
    assert spark.read.parquet(V.current(spark, path)).count() == 2

    calls = []

    def add(now):
        calls.append(1)
        if len(calls) == 1:  # another writer comes between the read and the commit
            V.update(spark, path, "parquet", lambda rows: rows.union(spark.range(100, 101)))
        return now.union(spark.range(200, 201))

    V.update(spark, path, "parquet", add)
    assert sorted(r.id for r in spark.read.parquet(V.current(spark, path)).collect()) == [0, 1, 100, 200] and len(calls) == 2


def test_parallel_writers_are_all_there(spark, tmp_path):
    log, failed = V.VersionLog(spark, str(tmp_path / "t")), []

    def write(k):
        try:
            for j in range(5):
                log.change(lambda head: ((head.state or []) + [[k, j]], []))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and sorted(log.head().state) == [[k, j] for k in range(4) for j in range(5)] and log.head().number == 20


class Dies(Exception):
    pass


@pytest.mark.parametrize("step", ["save", "create", "_name", "vacuum"])
def test_a_crash_at_any_step_leaves_a_readable_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    V.publish(spark.range(3), path, "parquet")

    def die(*a, **b):
        raise Dies

    if step == "save":
        df = spark.range(9).select(F.raise_error(F.lit("lost")).alias("id"))
    else:
        df = spark.range(9)
    with monkeypatch.context() as m:
        if step == "create":  # the marker is begun, not finished
            def part(self, base, state, folders, op="write"):
                (tmp_path / "t/_log/.half.tmp").write_text('{"version":')
                raise Dies
            m.setattr(V.VersionLog, "commit", part)
        elif step in ("_name", "vacuum"):
            m.setattr(V.VersionLog, step, die)
        with pytest.raises(Exception):
            V.publish(df, path, "parquet")
    assert spark.read.parquet(V.current(spark, path)).count() == (9 if step == "vacuum" else 3)
    V.publish(spark.range(4), path, "parquet")
    assert spark.read.parquet(V.current(spark, path)).count() == 4


def test_vacuum_keeps_what_readers_and_writers_need(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(1, 5):
        V.publish(spark.range(n), path, "parquet")
    log = V.VersionLog(spark, path)
    old = f"{path}/{log.read(1).state}"
    assert log.numbers() == [1, 2, 3, 4] and spark.read.parquet(old).count() == 1  # still read for an hour
    os.makedirs(f"{path}/versions/orphan")
    log.vacuum(0)
    assert log.numbers() == [3, 4] and len(os.listdir(f"{path}/versions")) == 2
    assert spark.read.parquet(V.current(spark, path)).count() == 4


def test_backup_is_the_first_version_whoever_writes(spark, tmp_path, monkeypatch):
    path, backup = str(tmp_path / "t"), str(tmp_path / "b")
    V.publish(spark.range(3), path, "parquet")
    real, raced = V.publish, []

    def publish(df, where, fmt, base=None, retain_s=V.RETAIN_S):
        if where == backup and not raced:  # another writer backs up and changes the table first
            raced.append(1)
            V.write_with_backup(spark.range(5), path, backup)
        return real(df, where, fmt, base, retain_s)

    monkeypatch.setattr(V, "publish", publish)
    V.write_with_backup(spark.range(7), path, backup)
    assert raced and spark.read.parquet(V.current(spark, backup)).count() == 3
    assert spark.read.parquet(V.current(spark, path)).count() == 7 and V.VersionLog(spark, path).head().number == 3


def test_runs_are_added_by_key(spark, tmp_path):
    path = str(tmp_path / "runs")
    schema = "arm string, question_id string, calls int"
    FS.add_runs(spark.createDataFrame([("a", "1", 1), ("a", "2", 1)], schema), path)
    FS.add_runs(spark.createDataFrame([("a", "2", 5), ("b", "1", 2)], schema), path)
    assert {(r.arm, r.question_id): r.calls for r in FS.load_runs(spark, path).collect()} == {("a", "1"): 1, ("a", "2"): 5, ("b", "1"): 2}


ROW = "k long, at long, v string, extra int"


def _table(spark, path, **how):
    return KeyedTable(spark, str(path), ["k"], ["at"], ["v"], **({"buckets": 4, "fan": 3} | how))


def test_upserts_merge_and_compact(spark, tmp_path):
    import random
    rnd, want, table = random.Random(3), {}, _table(spark, tmp_path / "t")
    with pytest.raises(LookupError):
        table.rows()
    at = 0
    for n in range(14):
        rows = []
        for _ in range(rnd.choice([0, 1, 7, 30])):
            k, at = rnd.choice([None, *range(20)]), at + 1
            rows.append((k, at, f"v{at}", 0))
            want[k] = f"v{at}"
        rnd.shuffle(rows)
        assert table.upsert(spark.createDataFrame(rows, ROW), "w", n)
        assert not table.upsert(spark.createDataFrame(rows, ROW), "w", n)  # delivered twice
        table.compact()
        assert {r.k: r.v for r in table.rows().collect()} == want
        assert table.depth() <= table.most(n + 1)
    late = spark.createDataFrame([(3, 0, "too old", 0)], ROW)
    table.upsert(late)
    assert {r.k: r.v for r in table.rows().collect()} == want
    keys = spark.createDataFrame([(3,), (None,), (99,)], "k long")
    assert {r.k: r.v for r in table.get(keys).collect()} == {k: want[k] for k in (3, None) if k in want}
    with pytest.raises(ValueError):
        _table(spark, tmp_path / "t", buckets=8).rows()


def test_a_merge_rewrites_full_buckets_alone(spark, tmp_path):
    table = _table(spark, tmp_path / "t")
    of = {r.b: r.id for r in spark.range(100).withColumnRenamed("id", "k").select(F.col("k").alias("id"), table._bucket().alias("b")).collect()}
    for n in range(3):
        table.upsert(spark.createDataFrame([(of[1], n, "x", 0)], ROW))
    table.upsert(spark.createDataFrame([(of[2], 9, "y", 0)], ROW))
    untouched = table.log.head().state["deltas"][-1]
    assert table.compact() == 1
    deltas = table.log.head().state["deltas"]
    assert [d["buckets"] for d in deltas] == [[1], [2]] and deltas[0]["tier"] == 1 and deltas[1] == untouched


def test_writers_of_one_table(spark, tmp_path, monkeypatch):
    """An upsert that meets another commit keeps both; a merge that lost its deltas gives up."""
    one, two = _table(spark, tmp_path / "t"), _table(spark, tmp_path / "t")
    for n in range(3):
        one.upsert(spark.createDataFrame([(k, n, f"{n}", 0) for k in range(8)], ROW))
    real, raced = V.VersionLog.commit, []

    def commit(self, *a, **b):
        if not raced:
            raced.append(1)
            two.upsert(spark.createDataFrame([(100, 1, "two", 0)], ROW))
            two.compact()
        return real(self, *a, **b)

    monkeypatch.setattr(V.VersionLog, "commit", commit)
    one.upsert(spark.createDataFrame([(200, 1, "one", 0)], ROW))
    assert {r.k: r.v for r in one.rows().collect()} == {k: "2" for k in range(8)} | {100: "two", 200: "one"}
    raced.clear()
    for n in range(3, 6):
        one.upsert(spark.createDataFrame([(k, n, f"{n}", 0) for k in range(8)], ROW))
    raced.clear()
    one.compact()
    assert {r.k: r.v for r in one.rows().collect()} == {k: "5" for k in range(8)} | {100: "two", 200: "one"}


def _with_batches(spark, path, n):
    """A table of ``n`` earlier batches of 50 rows, written in one job."""
    table = _table(spark, path, fan=8, buckets=2)
    rows = spark.range(n * 50, numPartitions=2).select(F.col("id").alias("k"), F.col("id").alias("at"), F.concat(F.lit("value "), "id").alias("v"))
    stage = rows.withColumn("batch", F.floor(F.col("k") / 50)).withColumn("_bucket", table._bucket())
    stage.repartition(8, "batch").write.partitionBy("batch", "_bucket").parquet(f"{table.log.path}/versions/all")
    deltas = [{"folder": f"versions/all/batch={b}", "buckets": sorted(int(x.split("=")[1]) for x in os.listdir(f"{table.log.path}/versions/all/batch={b}") if "=" in x), "tier": 0} for b in range(n)]
    state = {"buckets": 2, "schema": rows.schema.jsonValue(), "deltas": deltas, "writers": {}}
    table.log.commit(0, state, [d["folder"] for d in deltas])
    table.compact()
    return table


def test_bytes_of_a_batch_do_not_grow_with_the_table(spark, tmp_path):
    written = {}
    for n in (10, 1000):
        table = _with_batches(spark, tmp_path / f"t{n}", n)
        assert table.rows().count() == n * 50 and table.depth() <= table.most(n)
        before = _size(tmp_path / f"t{n}")
        table.upsert(spark.range(n * 50 - 25, n * 50 + 25, numPartitions=1).select(F.col("id").alias("k"), (F.col("id") + 10**6).alias("at"), F.lit("new").alias("v")))
        written[n] = _size(tmp_path / f"t{n}") - before
        assert table.rows().count() == n * 50 + 25 and table.rows().where("v = 'new'").count() == 50
    assert written[1000] < 1.3 * written[10], written


def _feed(spark, path, rows, schema="event_id long, ts timestamp, event_type string, value double"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _seconds(n):
    import datetime
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


EVENT = "ts timestamp, span_id long, event_type string, us long, closes boolean"


def test_spans_close_expire_and_resume(spark, tmp_path):
    """Ends before, with and after their starts, over restarts of the query."""
    feed, ck, out = (str(tmp_path / x) for x in ("feed", "ck", "out"))

    def run(rows):
        _feed(spark, feed, [(_seconds(at), span, kind, 1_000_000 * (1_704_067_200 + at), closes) for at, span, kind, closes in rows], EVENT)
        s = spark.readStream.schema(T._parse_datatype_string(EVENT)).option("maxFilesPerTrigger", 1).parquet(feed).withWatermark("ts", "60 seconds")
        return {r.span_id: (r.event_type, r.status, r.duration_us) for r in ST.pair_spans(s, ck, out, 100).collect()}

    assert run([(0, 1, "a", False), (5, 1, None, True), (10, 2, "b", False), (20, 4, None, True), (30, 5, "e", False)]) == {1: ("a", "ok", 5_000_000)}
    got = run([(40, 2, None, True), (15, 4, "d", False), (50, 6, "f", False), (51, 7, None, True)])
    assert got == {1: ("a", "ok", 5_000_000), 2: ("b", "ok", 30_000_000), 4: ("d", "ok", 5_000_000)}
    got = run([(400, 8, "h", False)])  # the watermark passes 30 + 100 and 50 + 100 seconds
    assert got == {1: ("a", "ok", 5_000_000), 2: ("b", "ok", 30_000_000), 4: ("d", "ok", 5_000_000), 5: ("e", "failed", None), 6: ("f", "failed", None)}
    assert run([(1000, 9, "i", False)])[8] == ("h", "failed", None)


def test_a_heartbeat_closes_windows_and_sessions(spark, tmp_path):
    feed = str(tmp_path / "feed")
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"
    rows = [(1, 1, _seconds(0), "a", 50.0, "{}"), (2, 1, _seconds(3600), "a", 10.0, "{}"), (3, 1, _seconds(90_000), "a", 50.0, "{}")]
    _feed(spark, feed, rows, schema)
    open_ = ST.session_accuracy(spark, feed, str(tmp_path / "c1"), str(tmp_path / "t1")).collect()
    assert open_ == []
    ST.heartbeat(spark.read.parquet(feed), feed)
    got = ST.session_accuracy(spark, feed, str(tmp_path / "c1"), str(tmp_path / "t1")).collect()
    assert sorted((r.attempts, r.ok) for r in got) == [(1, 1), (2, 1)]
    assert ST.session_accuracy(spark, feed, str(tmp_path / "c1"), str(tmp_path / "t1")).count() == 2  # nothing twice
    runs = ST.upsert_runs(spark, feed, str(tmp_path / "c2"), str(tmp_path / "t2")).collect()
    assert [(r.arm, r.question_id, r.event_id) for r in runs] == [("a", 1, 3)]
