"""Versioned writes, run logs, notebooks and restarted streams."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.sources import files as FS
from tessera.sources import printed
from tessera.streaming import streams as ST

from .conftest import SF001


def test_publish_switches_and_cleans(spark, tmp_path):
    path = str(tmp_path / "t")
    assert FS.current(spark, path) is None
    for i in range(4):
        FS.publish(spark.range(i + 1), path, "parquet", retain_s=0)
        assert spark.read.parquet(FS.current(spark, path)).count() == i + 1
    assert len(os.listdir(f"{path}/versions")) == 2


def test_a_failed_write_keeps_the_published_version(spark, tmp_path):
    path = str(tmp_path / "t")
    FS.publish(spark.range(3), path, "parquet")
    with pytest.raises(Exception):
        FS.publish(spark.range(9).select(F.raise_error(F.lit("lost"))), path, "parquet")
    assert spark.read.parquet(FS.current(spark, path)).count() == 3


def test_backup_is_taken_once(spark, tmp_path):
    path, backup = str(tmp_path / "t"), str(tmp_path / "b")
    for n in (3, 5, 7):
        FS.write_with_backup(spark.range(n), path, backup)
    assert spark.read.parquet(FS.current(spark, backup)).count() == 3 and spark.read.parquet(FS.current(spark, path)).count() == 7


def test_run_log_without_times_takes_the_last_line(spark, tmp_path):
    rows = [{"arm": "a", "question_id": "1", "correct": False}, {"arm": "a", "question_id": "1", "correct": True}, {"arm": "b", "question_id": "1", "correct": True}]
    (tmp_path / "log.json").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
    got = {r.arm: r.correct for r in FS.load_runs(spark, str(tmp_path / "log.json")).collect()}
    assert got == {"a": True, "b": True}
    assert FS.load_runs(spark, str(tmp_path / "none.json")).count() == 0


def test_notebook_rows(spark, tmp_path):
    text = ["{('a', 1): Row(strategy='a', question_id=1, db_id='d', difficulty='simple', correct=True, draft_correct=False, calls=2, seconds=1.5, ",
            "repaired=True, agents=['w', \"c\"], sql='x'),\n ('a', 2): Row(strategy='a', question_id=2, sql=\"f(x), y, Row(correct=False), 'q'\", correct=True, calls=7, ",
            "seconds=2.5, repaired=True, agents=['w']), ('a', 1): Row(strategy='a', question_id=1, correct=False),\n ('b', 3): Row(strategy='b', question_id=3, calls=4, sql='cut off ...\n",
            " ('b', 4): Row(strategy='b', question_id=4, correct=True)}"]
    book = {"cells": [{"cell_type": "markdown"}, {"cell_type": "code", "outputs": [
        {"output_type": "stream", "text": ["Row(strategy='z', question_id=9),"]}, {"output_type": "execute_result", "data": {"text/plain": text}}]}]}
    (tmp_path / "n.ipynb").write_text(json.dumps(book, indent=1))
    got = {r.question_id: r for r in FS.recover_rows(spark, str(tmp_path / "n.ipynb")).collect()}
    assert set(got) == {1, 2, 3, 4} and not got[1].correct and got[1].calls == 0 and got[1].sql == "" and got[1].agents == []
    assert (got[2].correct, got[2].calls, got[2].seconds, got[2].repaired, got[2].agents, got[2].complete) == (True, 7, 2.5, True, ["w"], True)
    assert got[3].calls == 4 and not got[3].complete and got[4].correct and got[4].complete


def test_printed_rows():
    one = lambda text: printed.rows(text)[0]
    assert one("Row(a='it\\'s (so), b=2', b=3)") == ({"a": "it's (so), b=2", "b": 3}, True)
    assert one("Row(a=[1, 'x, y', [None]], b=[], c=-1.5e3, d=None)") == ({"a": [1, "x, y", [None]], "b": [], "c": -1500.0, "d": None}, True)
    assert one("Row()") == ({}, True) and printed.rows("Rows(a=1) myRow(a=1) Row (a=1) Row(x)") == []
    assert one("Row(a=1, a=2)") == ({"a": 1}, True)
    assert printed.rows("Row(a=1, b='cut Row(a=2, b=3)") == [({"a": 1}, False), ({"a": 2, "b": 3}, True)]
    assert printed.rows("Row(a=1, b=[1, 2) Row(a=2") == [({"a": 1}, False), ({}, False)] or printed.rows("Row(a=1, b=[1, 2)")[0] == ({"a": 1}, False)
    n = 20_000
    assert len(printed.rows("Row(a='" * n)) == n


def test_streams_run_in_several_batches_and_resume(spark, tmp_path):
    feed = ST.feed(spark, SF001)
    files = sorted((f for f in os.listdir(feed.removeprefix("file:")) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(os.path.join(feed.removeprefix("file:"), f)))
    assert len(files) >= ST.FEED_PARTS
    part = str(tmp_path / "part")
    os.makedirs(part)
    ck, table = str(tmp_path / uuid.uuid4().hex), str(tmp_path / "table")
    for f in files[:2]:
        os.link(os.path.join(feed.removeprefix("file:"), f), os.path.join(part, f))
    first = {(r.arm, r.question_id): r.event_id for r in ST.upsert_runs(spark, part, ck, table).collect()}
    for f in files[2:]:
        os.link(os.path.join(feed.removeprefix("file:"), f), os.path.join(part, f))
    after = {(r.arm, r.question_id): r.event_id for r in ST.upsert_runs(spark, part, ck, table).collect()}  # a new query, the same checkpoint
    batch = spark.read.parquet(f"{SF001}/events.parquet").groupBy("event_type", "user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e"))
    assert set(first) <= set(after) and first != after and after == {(r.event_type, r.user_id): r.e for r in batch.collect()}
    assert len(os.listdir(f"{ck}/commits")) >= ST.FEED_PARTS
