"""Sketches per file: an appended table reads only its new files, and the profile is close."""

import os

from pyspark.sql import functions as F

from tessera.operators import sketches as S
from tessera.sources.versions import VersionLog


def _rows(spark, low, high):
    n = F.col("id")
    return spark.range(low, high).select(
        n.alias("key"), (n % 700).cast("int").alias("few"), F.concat(F.lit("ü"), (n % 5000).cast("string")).alias("word"),
        F.when(n % 4 == 0, None).otherwise(n.cast("double") / 7).alias("part"), F.lit(None).cast("string").alias("none"),
        F.array(n % 3).alias("list"), F.lit(1).cast("decimal(10,2)").alias("with space"))


def test_only_new_files_are_read(spark, tmp_path):
    table, store = str(tmp_path / "a table+1"), str(tmp_path / "store")
    _rows(spark, 0, 40_000).repartition(3).write.parquet(table)
    assert S.refresh(spark, table, store) == 3
    assert S.refresh(spark, table, store) == 0 and VersionLog(spark, store).head().number == 1
    before = {p: os.stat(os.path.join(table, p)).st_mtime for p in os.listdir(table) if p.endswith(".parquet")}
    _rows(spark, 40_000, 60_000).coalesce(1).write.mode("append").parquet(table)
    added = [p for p in os.listdir(table) if p.endswith(".parquet") and p not in before]
    assert S.refresh(spark, table, store) == len(added) == 1
    head = VersionLog(spark, store).head()
    last = spark.read.parquet(f"{store}/{head.state[-1]}")
    assert [os.path.basename(r.file) for r in last.select("file").distinct().collect()] == added

    whole = spark.read.parquet(table)
    got = {r.column_name: r for r in S.profile(spark, table, store).collect()}
    assert set(got) == set(whole.columns)
    for c in whole.columns:
        exact = whole.agg(F.count_distinct(f"`{c}`"), F.count_if(F.col(f"`{c}`").isNull())).first()
        assert got[c].n_rows == 60_000 and got[c].null_count == exact[1], c
        assert abs(got[c].n_distinct - exact[0]) <= 0.05 * exact[0], c
    assert (got["key"].least, got["key"].greatest) == ("0", "59999")
    assert (got["word"].least, got["word"].greatest) == ("ü0", "ü999")
    for c, top in (("key", 60_000), ("few", 700), ("part", 60_000 / 7)):
        assert all(abs(v - q * top) <= 0.03 * top for q, v in zip(S.QUANTILES, got[c].quantiles, strict=True)), c
    assert got["none"].quantiles is None and got["none"].n_distinct == 0 and got["none"].least is None and got["list"].least is None

    # a store written twice for the same files counts them once; a removed file counts no more
    again = f"{store}/{VersionLog(spark, store).folder()}"
    last.write.parquet(again)
    folder = again[len(store) + 1:]
    VersionLog(spark, store).change(lambda h: ([*h.state, folder], [*h.state, folder]))
    assert {r.n_rows for r in S.profile(spark, table, store).collect()} == {60_000}
    n = spark.read.parquet(f"{table}/{added[0]}").count()
    os.remove(os.path.join(table, added[0]))
    assert {r.n_rows for r in S.profile(spark, table, store).collect()} == {60_000 - n}


def test_a_column_that_came_later(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    spark.range(10).write.parquet(table)
    S.refresh(spark, table, store)
    spark.range(10, 15).select("id", F.lit(float("nan")).alias("x")).write.mode("append").parquet(table)
    S.refresh(spark, table, store)
    got = {r.column_name: r for r in S.profile(spark, table, store).collect()}
    assert got["id"].n_rows == 15 and got["x"].n_rows == 15 and got["x"].null_count == 10 and got["x"].quantiles is None


def test_an_empty_table(spark, tmp_path):
    os.makedirs(tmp_path / "t")
    assert S.refresh(spark, str(tmp_path / "t"), str(tmp_path / "s")) == 0
    assert S.profile(spark, str(tmp_path / "t"), str(tmp_path / "s")).count() == 0
