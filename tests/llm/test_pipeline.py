"""The pipeline's stages against plain versions of their decisions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import pii, quality, stages

from ..conftest import SF001
from .test_neardup import brute
from .test_phrases import words


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (3, None, "en", "s", None)], base.schema)
    again = base.where("doc_id < 5")
    return base.union(odd).union(again).repartition(3).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_keeps_what_the_model_accepts(spark, docs):
    out = stages.keep_quality(spark, docs, SF001)
    assert out.schema == docs.schema or out.columns == docs.columns
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    kept = {r.doc_id for r in out.collect()}
    good = [i for i, q in label.items() if q == 1]
    assert set(rows(out)) <= set(rows(docs)) and sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, q in label.items() if q == 0) <= 0.1 * max(sum(q == 0 for q in label.values()), 10)


def test_one_document_of_each_group(spark, docs):
    out = stages.drop_near_duplicates(spark, docs, SF001)
    every = [(r.doc_id, r.text) for r in docs.collect()]
    want = {}
    for (i, n, c, kept) in brute(every):
        if kept and n:
            want[i] = 1
    got = [repr(r.doc_id) for r in out.collect() if (r.text or "").split()]
    assert sorted(got) == sorted(want) and out.columns == docs.columns
    assert out.where("text is null or trim(text) = ''").count() == docs.where("text is null or trim(text) = ''").count()


def test_no_benchmark_window_is_left(spark, docs):
    items = set()
    for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect():
        w = words(r.text)
        items |= {tuple(w[s:s + min(10, len(w))]) for s in range(max(len(w) - 10, 0) + 1) if w}
    sizes = {len(x) for x in items}

    def bad(text):
        w = words(text)
        return any(tuple(w[s:s + n]) in items for n in sizes for s in range(len(w) - n + 1))

    out = stages.drop_contaminated(spark, docs, SF001)
    assert rows(out) == sorted([tuple(r) for r in docs.collect() if not bad(r.text)], key=repr) and out.columns == docs.columns


def test_spans_are_redacted(spark, docs):
    w = np.frombuffer(pii.fitted()).reshape(pii.FEATURES, -1)
    want = []
    for r in docs.collect():
        spans = pii.find(r.text, w)[1]
        text = pii.redact(r.text, spans)
        want.append((r.doc_id, text, r.lang, r.source, len(text) if spans else r.n_chars))
    assert rows(stages.redact_pii(spark, docs, SF001)) == sorted(want, key=repr)


def test_run_equals_the_stages_one_by_one(spark):
    out = corpus_pipeline.run(spark, SF001)
    last = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        last = spark.createDataFrame(stage(spark, last, SF001).collect(), last.schema)
    pieces = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert pieces.where("n != t").count() == 0 and {r.doc_id for r in pieces.collect()} == {r.doc_id for r in last.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "neardup", "decontamination", "pii", "packing"]


def test_stages_on_an_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF001).count() == 0


def test_clashing_columns_pass_through(spark, docs):
    odd = docs.withColumns({c: F.lit(7) for c in ("row", "kept", "score", "component", "spans", "doc", "predicted", "_text", "held_out")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF001).columns == odd.columns
    assert quality.THRESHOLD == 0.3
