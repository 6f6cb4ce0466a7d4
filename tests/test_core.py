"""Unit and property tests for the shared plan helpers and GRD/WIN/LOG rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.normalise import normalise_rows
from tessera.operators import attempts as W
from tessera.operators import compare as C
from tessera.operators import querylog as L
from tessera.operators.carried import bounded_notes
from tessera.plans.ordered import ordered_scan, previous_value


def test_ordered_scan_matches_window_many_slices(spark, t):
    e = t.events.select("event_type", "user_id", "ts", "event_id", "value")
    got = ordered_scan(e, ["event_type"], ["ts", "event_id"], seq="n", sums={"r": F.col("value")}, n_slices=9)
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    ref = e.select("event_id", F.row_number().over(w).alias("n2"),
                   F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("r2"))
    j = got.join(ref, "event_id")
    assert got.count() == e.count()
    assert j.where((F.col("n") != F.col("n2")) | (F.abs(F.col("r") - F.col("r2")) > 1e-6)).count() == 0


def test_ordered_scan_global_and_lag(spark, t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    got = ordered_scan(o, [], ["o_orderkey"], seq="pos", n_slices=7)
    assert sorted(r.pos for r in got.collect()) == list(range(1, o.count() + 1))
    lagged = previous_value(got, [], "pos", ["o_orderkey"])
    bad = lagged.where(F.col("prev_o_orderkey").isNotNull() & (F.col("prev_o_orderkey") >= F.col("o_orderkey")))
    assert bad.count() == 0


def _verdict(pred, gold):
    return C.compare(pred, gold).first()


def test_compare_negative_cases(spark):
    gold = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.5)], "id int, name string, v double")
    assert _verdict(gold, gold).correct
    changed = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.6)], "id int, name string, v double")
    r = _verdict(changed, gold)
    assert not r.correct and r.reason == "same row count, different values"
    swapped = gold.select("name", "id", "v")
    assert not _verdict(swapped, gold).correct
    doubled = gold.unionByName(gold.limit(1))
    r = _verdict(doubled, gold)
    assert not r.correct and r.reason == "row count differs: got 3, expected 2"
    dropped = gold.where("id = 1")
    assert not _verdict(dropped, gold).correct
    extra = gold.withColumn("x", F.lit(1))
    assert not _verdict(extra, gold).correct


def test_compare_normalisation(spark):
    a = spark.createDataFrame([(4, " x\t")], "n long, s string")
    b = spark.createDataFrame([(4.0, "x")], "n double, s string")
    assert _verdict(a, b).correct
    c = spark.createDataFrame([(1.0000001,)], "v double")
    d = spark.createDataFrame([(1.0,)], "v double")
    assert _verdict(c, d).correct
    e = spark.createDataFrame([(None,)], "v string")
    f = spark.createDataFrame([("None",)], "v string")
    assert not _verdict(e, f).correct  # null-safe, unlike str() in the reference
    g = spark.createDataFrame([(True,)], "v boolean")
    h = spark.createDataFrame([(1,)], "v int")
    assert not _verdict(g, h).correct


def test_normalised_text(spark):
    df = spark.createDataFrame([(0.1 + 0.2, 12.0, 1e16, 1234.5)], "a double, b double, c double, d double")
    assert normalise_rows(df).first().row == ["0.3", "12", "10000000000000000", "1234.5"]


def test_compare_is_symmetric_in_match(spark, t):
    a = t.customer.select("c_custkey", "c_name")
    b = t.customer.select("c_custkey", "c_name").orderBy(F.desc("c_custkey"))
    assert _verdict(a, b).correct and _verdict(b, a).correct


def test_fingerprint_equal_sets(spark):
    a = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("r", 2, "y"), ("r", 1, "x")], "g string, a int, b string")
    fp = {r.g: (r.n_rows, r.fp1, r.fp2) for r in C.fingerprint(a, ["g"], ["a", "b"]).collect()}
    assert fp["q"] == fp["r"]
    four = spark.createDataFrame([("q", 4.0), ("r", 4.0)], "g string, v double")
    four_int = spark.createDataFrame([("q", 4)], "g string, v int")
    assert (C.fingerprint(four, ["g"], ["v"]).first().fp1 != C.fingerprint(four_int, ["g"], ["v"]).first().fp1)
    assert (C.fingerprint(four, ["g"], ["v"], normalised=True).where("g = 'q'").first().fp1
            == C.fingerprint(four_int, ["g"], ["v"], normalised=True).first().fp1)


def test_execution_accuracy(spark, t):
    t.customer.createOrReplaceTempView("customer")
    ok, reason, _, _ = C.execution_accuracy(spark, "SELECT count(*) FROM customer", "SELECT count(1) AS n FROM customer")
    assert ok and reason == "match"
    assert C.execution_accuracy(spark, " ", "SELECT 1")[1] == "no query produced"
    assert C.execution_accuracy(spark, "SELECT nope FROM customer", "SELECT 1")[1].startswith("query failed")
    assert C.execution_accuracy(spark, "SELECT 1", "SELECT x FROM nowhere")[1].startswith("REFERENCE QUERY FAILED")
    ok, *_ = C.execution_accuracy(spark, "SELECT c_custkey FROM customer ORDER BY c_custkey DESC",
                                  "SELECT c_custkey FROM customer ORDER BY c_custkey")
    assert not ok
    ok, *_ = C.execution_accuracy(spark, "SELECT c_custkey FROM customer ORDER BY c_custkey",
                                  "SELECT c_custkey FROM customer ORDER BY c_custkey")
    assert ok


def test_attempt_actions(spark):
    att = spark.createDataFrame([
        ("a", 1, 1, False, "x", "e1"), ("a", 1, 2, False, "y", "e2"), ("a", 1, 3, True, "z", None),
        ("a", 2, 1, False, "x  1", "e"), ("a", 2, 2, False, "x 1", "e"), ("a", 2, 3, True, "w", None),
        ("a", 3, 1, True, "q", None), ("a", 3, 2, False, "r", "e"),
        ("a", 4, 1, False, "p", "e"), ("a", 4, 2, False, "s", "e"), ("a", 4, 3, False, "t", "e"),
        ("a", 4, 4, True, "u", None)],
        "arm string, question_id long, attempt_no int, ok boolean, sql string, error string")
    acts = {(r.question_id, r.attempt_no): r.action for r in W.attempt_actions(att).collect()}
    assert acts == {(1, 1): "repairing", (1, 2): "repairing", (1, 3): "accepted",
                    (2, 1): "no-change", (3, 1): "accepted",
                    (4, 1): "repairing", (4, 2): "repairing", (4, 3): "exhausted"}
    lessons = W.verified_lessons(att).collect()
    assert [(r.question_id, r.broken_sql, r.error, r.fixed_sql) for r in lessons] == [(1, "x", "e1", "z")]


def test_best_round(spark):
    rounds = spark.createDataFrame([
        (1, 1, 2, 2, 2, 2, 0, "a"), (1, 2, 3, 3, 3, 3, 0, "b"), (1, 3, 3, 3, 3, 3, 0, "c"),
        (2, 1, 0, 0, 0, 0, 1, "d"), (2, 2, 0, 0, 0, 0, 1, "e"), (2, 3, 0, 0, 0, 0, 0, "f"),
        (3, 1, 0, 0, 0, 0, 1, "g"), (3, 2, 0, 0, 0, 0, 1, "h"),
        (4, 1, 2, 2, 1, 1, 0, "i"), (4, 2, 2, 2, 2, 0, 0, "j")],
        "question_id long, round int, c1 int, c2 int, c3 int, c4 int, schema_errors int, sql string")
    got = {r.question_id: (r.final_round, r.final_sql, r.best_score) for r in W.best_round(rounds).collect()}
    assert got[1] == (2, "b", 12)       # stops at the first passing round
    assert got[2] == (3, "f", 0)        # round 3 scores 0 > -1: the strict best
    assert got[3] == (1, "g", -1)       # all below 0 and last not clean: first draft stays
    assert got[4] == (1, "i", 6)        # earliest of equal maxima


def test_stalls(spark):
    spans = spark.createDataFrame([("r", i + 1, s) for i, s in enumerate(["a", "b", "a", "b", "c", "c", "c", "a"])],
                                  "run_id string, seq int, signature string")
    got = [(r.is_repeat, r.stalled) for r in W.stalls(spans).orderBy("seq").collect()]
    assert got == [(False, 0), (False, 0), (True, 1), (True, 2), (False, 0), (True, 1), (True, 2), (True, 3)]


def test_bounded_notes_reentry(spark):
    notes = spark.createDataFrame([("r", "s", i, n) for i, n in enumerate(["A", "B", "A", "C", "A"])],
                                  "run_id string, slot string, seq int, note string")
    got = [r.note for r in bounded_notes(notes, 2).orderBy("position").collect()]
    assert got == ["C", "A"]  # A is known at first, evicted by C, and comes in again


BLOCKED = ["DELETE FROM part", "DROP TABLE part", "SELECT 1; DROP TABLE part", "UPDATE part SET p_size = 1",
           "INSERT INTO part VALUES (1)", "PRAGMA table_info(part)", "SELECT load_extension('x')",
           "ATTACH DATABASE 'x' AS y", "CREATE TABLE t (a int)", "ALTER TABLE part ADD c int", "", "   ",
           "WITH t AS (DELETE FROM part) SELECT 1", "SELECT readfile('/etc/passwd')", "VACUUM", "REPLACE INTO part VALUES (1)"]
ALLOWED = ["SELECT * FROM part", "SELECT p_name FROM part WHERE p_name = 'drop table'",
           "WITH t AS (SELECT 1 AS a) SELECT a FROM t", "SELECT 1 -- ; DROP TABLE part",
           "(SELECT 1) UNION (SELECT 2)"]


def test_screen_cases(spark):
    rows = [(i, s) for i, s in enumerate(BLOCKED + ALLOWED)]
    log = spark.createDataFrame(rows, "query_id int, sql string")
    got = {r.query_id: r.verdict for r in L.screen(log).collect()}
    assert all(got[i] != "ok" for i in range(len(BLOCKED))), got
    assert all(got[len(BLOCKED) + i] == "ok" for i in range(len(ALLOWED))), got


def test_risk_tier(spark):
    log = spark.createDataFrame([
        (1, "SELECT count(*) FROM part"),
        (2, "SELECT a.x FROM t a JOIN t b ON a.id = b.id LEFT JOIN u ON u.id = a.id WHERE a.v > (SELECT avg(v) FROM t)"),
        (3, "not sql at all"), (4, "")], "query_id int, sql string")
    got = {r.query_id: (r.score, r.tier) for r in L.risk_tier(log).collect()}
    assert got[1] == (1, "trust")  # one aggregate, count(*) is not a multiplication
    assert got[2][1] == "verify" and got[2][0] == 2 + 1 + 2 + 1 + 2
    assert got[3] == (99, "verify") and got[4] == (99, "verify")
