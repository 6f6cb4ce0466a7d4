"""Rollups against a recount from scratch, repeated and failed batches included."""

import random
import uuid

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import queries as Q
from tessera.llm import token_rollup as R
from tessera.llm.common import shared_dir

from ..conftest import SF001


def rollup(spark):
    return R.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")


def totals(r):
    return {(x.source, x.lang, x.tokenizer_version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def recount(batches):
    live, nameless = {}, []
    for rows in batches:
        last = {}
        for r in rows:
            i, v, s, g, n, op, seq = r
            if i is None:
                nameless += [(s, g, v, n or 0)] if op == "insert" else []
            elif (i, v) not in last or (seq, n or 0, op) > last[i, v][0]:
                last[i, v] = ((seq, n or 0, op), s, g)
        for (i, v), ((_, n, op), s, g) in last.items():
            live.pop((i, v), None)
            if op != "delete":
                live[i, v] = (s, g, v, n)
    out = {}
    for s, g, v, n in [*live.values(), *nameless]:
        d, t = out.get((s, g, v), (0, 0))
        out[s, g, v] = (d + 1, t + n)
    return out


def test_random_batches_equal_a_recount(spark):
    rnd, r, done = random.Random(4), rollup(spark), []
    r.compact_at = 3
    for k in range(5):
        rows = [(rnd.choice([None, *map(str, range(12))]), rnd.choice("ab"), rnd.choice(["s", "t", None]), rnd.choice(["en", None]), rnd.choice([None, 0, 5, 7]),
                 rnd.choice(["insert", "revise", "delete"]), j) for j in range(14)]
        frame = spark.createDataFrame(rows, R.CHANGE)
        assert r.apply(f"b{k}", frame) and not r.apply(f"b{k}", frame)
        done.append(rows)
        assert totals(r) == recount(done)
    assert totals(R.Rollup(spark, r.path)) == recount(done)


def test_a_failed_attempt_changes_nothing(spark, monkeypatch):
    r = rollup(spark)
    rows = spark.createDataFrame([("1", "v", "s", "en", 3, "insert", 0)], R.CHANGE)
    with monkeypatch.context() as m:
        m.setattr(R, "GROUP", ["no such column"])  # fails after the ledger is written
        with pytest.raises(Exception):
            r.apply("b", rows)
    assert r.committed() == [] and totals(r) == {}
    assert r.apply("b", rows) and totals(r) == {("s", "en", "v"): (1, 3)}


def test_batches_prepared_against_one_state(spark, monkeypatch):
    """The second of two writers signs its batch again: one document is one document."""
    r, other = rollup(spark), []
    one = spark.createDataFrame([("1", "v", "s", "en", 5, "insert", 0)], R.CHANGE)
    two = spark.createDataFrame([("1", "v", "s", "en", 7, "insert", 0)], R.CHANGE)
    real = R.VersionLog.commit

    def commit(self, *a, **b):
        if not other:
            other.append(1)
            assert R.Rollup(spark, r.path).apply("two", two)
        return real(self, *a, **b)

    monkeypatch.setattr(R.VersionLog, "commit", commit)
    assert r.apply("one", one) and sorted(r.committed()) == ["one", "two"]
    assert totals(r) == {("s", "en", "v"): (1, 5)}


def test_a_writer_that_dies_while_it_commits(spark, monkeypatch):
    r = rollup(spark)
    rows = spark.createDataFrame([("1", "v", "s", "en", 3, "insert", 0)], R.CHANGE)
    with monkeypatch.context() as m:
        m.setattr(R.VersionLog, "_name", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            r.apply("b", rows)
    again = R.Rollup(spark, r.path)
    assert again.committed() == [] and totals(again) == {} and again.live().count() == 0
    assert again.apply("b", rows) and totals(again) == {("s", "en", "v"): (1, 3)}


def test_a_null_id_is_counted_once(spark):
    r = rollup(spark)
    for k, op in enumerate(["insert", "revise", "delete"]):
        r.apply(str(k), spark.createDataFrame([(None, "v", "s", "en", 3 + k, op, 0)], R.CHANGE))
    assert totals(r) == {("s", "en", "v"): (1, 3)}


def test_compaction_keeps_counts_and_removes_ledgers(spark):
    r = R.Rollup(spark, rollup(spark).path, compact=3, retain_s=0)
    for k in range(7):
        r.apply(str(k), spark.createDataFrame([("1", "v", "s", "en", k, "revise", 0), (f"d{k}", "v", "s", "en", 1, "insert", 0)], R.CHANGE))
    state = r.log.head().state
    assert len(state["ledgers"]) < 3 and len(state["batches"]) == 7
    assert totals(r) == {("s", "en", "v"): (8, 7 + 6)} and r.live().count() == 8
    assert not r.apply("0", spark.createDataFrame([("1", "v", "s", "en", 99, "revise", 0)], R.CHANGE))


def test_empty_batches(spark):
    r = rollup(spark)
    assert totals(r) == {} and r.apply("none", spark.createDataFrame([], R.CHANGE)) and totals(r) == {}


def test_query_equals_the_tokenizer(spark, t):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    gone = {r.doc_id for r in t.labels.where("toxic = 1").collect()}
    want = {}
    for r in t.documents.collect():
        if r.doc_id not in gone:
            d, n = want.get((r.source, r.lang), (0, 0))
            want[r.source, r.lang] = (d + 1, n + len(tok.encode(r.text, add_special_tokens=False).ids))
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in Q.op3_token_counts(spark, SF001).collect()} == want


def test_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, None, 5), (None, "", "s", "x", 5), (2, "a " * 50_000, "s", "x", 5)], "doc_id long, text string, source string, lang string, tokens int")
    assert sorted(r.tokens for r in R.count_tokens(df).collect()) == [0, 0, len(R.encoder()("a " * 50_000)) // 4]
