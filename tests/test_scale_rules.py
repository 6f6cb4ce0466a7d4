"""Skew, caps and null keys: results do not depend on slices, depth, width or size."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import board as B
from tessera.operators import compare as C
from tessera.operators import forest as FO
from tessera.operators import ops as O
from tessera.operators import paths as PT
from tessera.operators import querylog as L
from tessera.operators import similarity as S
from tessera.plans import joins as J
from tessera.plans.ordered import ordered_scan, previous_value


def _plain(df, groups, order):
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumns({"n2": F.row_number().over(w), "s2": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))})


def test_ordered_scan_null_groups_and_keys(spark):
    rows = [(g, k, i, None if i % 4 == 0 else i) for i, (g, k) in enumerate([(None, None), (None, 2), ("a", None), ("a", 3), ("a", 3), ("b", 9), (None, 1), ("a", 1), ("b", None)])]
    df = spark.createDataFrame(rows, "g string, k int, id int, v int")
    want = sorted(map(repr, _plain(df, ["g"], ["k", "id"]).select("g", "k", "id", "n2", "s2").collect()))
    for n in (1, 2, 5, 40):
        got = ordered_scan(df, ["g"], ["k", "id"], seq="n2", sums={"s2": F.col("v")}, n_slices=n).select("g", "k", "id", "n2", "s2")
        assert sorted(map(repr, got.collect())) == want
    lagged = previous_value(ordered_scan(df, ["g"], ["k", "id"], seq="n", n_slices=3), ["g"], "n", ["id"])
    assert lagged.where("g is null and n = 2").first().prev_id == 0


def test_hot_group_is_split(spark):
    df = spark.range(0, 20000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))).alias("g"),
                                      (F.col("id") * 7919 % 20011).alias("k"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ordered_scan(df, ["g"], ["k", "id"], seq="n", n_slices=16)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(g" in plan and "_slice" in plan
        assert out.where("g = 'hot'").agg(F.max("n")).first()[0] == 15000 and out.select("g", "n").distinct().count() == 20000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Rows of the hot group per slice, as the numbering window's tasks get them.
    sliced = df.repartitionByRange(16, "g", "k", "id").withColumn("s", F.spark_partition_id()).where("g = 'hot'").groupBy("s").count().collect()
    assert len(sliced) >= 10 and max(r["count"] for r in sliced) < 3000


def test_a_deep_chain_of_spans(spark):
    chain = spark.range(1, 101).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("seq"), (F.col("id") - 1).cast("int").alias("parent_seq"))
    got = O.spans_flat(chain)
    assert got.count() == 100 and got.agg(F.max("depth")).first()[0] == 99


def test_a_long_path_and_its_conditions(spark):
    line = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "src string, dst string")
    paths = PT.shortest_paths(line, spark.createDataFrame([("n0",)], "node string"))
    assert {r.node: r.hops for r in paths.collect()} == {f"n{i}": i for i in range(1, 7)}
    steps = PT.route(paths, spark.createDataFrame([("n0", "n6"), ("n0", "zz")], "source string, node string")).orderBy("step").collect()
    assert [(r.src, r.dst) for r in steps] == [(f"n{i}", f"n{i + 1}") for i in range(6)]
    refs = spark.createDataFrame([("a", "b_id", "b", "id"), ("b", "c_id", "c", "id"), ("x", "y_id", "y", "id")], "table string, column string, ref_table string, ref_column string")
    assert PT.join_path(refs, "a", "c") == [("a", "b_id", "b", "id"), ("b", "c_id", "c", "id")]
    assert PT.join_path(refs, "c", "a") == [("c", "id", "b", "c_id"), ("b", "id", "a", "b_id")]
    assert PT.join_path(refs, "a", "y") == []


def test_reasons_that_differ_late(spark):
    long = "crashed: " + "x" * 80
    runs = spark.createDataFrame([(long + "1",), (long + "2",), (long + "2",), ("match",)], "reason string")
    assert [(r.reason, r.n) for r in B.top_reasons(runs).collect()] == [(long + "2", 2), (long + "1", 1)]


def test_parentheses_of_any_depth(spark):
    sql = "SELECT a FROM t WHERE b IN (SELECT f(g(h(i(x)))) FROM u GROUP BY y) HAVING z"
    df = spark.createDataFrame([(1, sql), (2, "SELECT \"update\" FROM t")], "query_id int, sql string")
    f = {r.query_id: r for r in L.features(df).collect()}
    assert not f[1].has_group_by and f[1].has_having
    assert {r.query_id: r.verdict for r in L.screen(df).collect()} == {1: "ok", 2: "ok"}


def test_bounded_looks_again(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    hinted = lambda: "broadcast" in J.bounded(spark.read.parquet(path), 10)._jdf.queryExecution().logical().toString().lower()
    assert hinted()
    spark.range(100).write.mode("append").parquet(path)
    assert not hinted()


def test_percentiles_are_exact(spark):
    spans = spark.createDataFrame([("a", float(v), i, "ok") for i, v in enumerate([5, 1, 4, 2, 3, 9, 9])] + [("b", 7.0, 50, "failed"), ("c", None, 60, "ok")],
                                  "agent string, elapsed double, span_id int, status string")
    got = {r.agent: (r.p50, r.p95) for r in O.span_stats(spans).collect()}
    want = {r.agent: (r.p, r.q) for r in spans.groupBy("agent").agg(F.round(F.percentile("elapsed", 0.5), 4).alias("p"), F.round(F.percentile("elapsed", 0.95), 4).alias("q")).collect()}
    assert got == want


def test_grading_of_odd_results(spark):
    def verdict(p, g):
        return C.compare(p, g).first()

    a, b = (spark.sql(f"SELECT CAST({x} AS DECIMAL(30,2)) AS v") for x in ("12345678901234567.12", "12345678901234567.89"))
    assert not verdict(a, b).correct and verdict(a, a).correct
    assert verdict(spark.sql("SELECT CAST(4.50 AS DECIMAL(9,2)) AS v"), spark.sql("SELECT 4.5D AS v")).correct
    assert verdict(spark.sql("SELECT 1 AS a WHERE false"), spark.sql("SELECT 1 AS a, 2 AS b WHERE false")).correct
    boom = "SELECT CAST(raise_error('boom') AS INT) AS x FROM range(3)"
    fine = "SELECT id FROM range(3) ORDER BY id"
    assert C.execution_accuracy(spark, boom, fine)[1].startswith("query failed")
    assert C.execution_accuracy(spark, fine, boom + " ORDER BY x")[1].startswith("REFERENCE QUERY FAILED")
    pairs = spark.createDataFrame([("p", "a | b", "c"), ("q", "a", "b | c"), ("r", None, "x"), ("s", "<NULL>", "x")], "g string, x string, y string")
    assert len({(r.fp1, r.fp2) for r in C.fingerprint(pairs, ["g"], ["x", "y"]).collect()}) == 4


def test_admit_strips_the_error(spark):
    c = spark.createDataFrame([("s", "e", "a", "b", 1), ("s", "e ", "a", "b", 2), ("s", "f", "a", "b", 3)], "scope string, error string, broken_sql string, fixed_sql string, arrival int")
    assert sorted(r.arrival for r in S.admit(c, c.limit(0)).collect()) == [1, 3]


def test_recall_equals_brute_force(spark):
    import random
    rnd = random.Random(2)
    sets = [(i, rnd.choice("st"), sorted(rnd.sample("abcdefghijkl", rnd.randint(0, 7)))) for i in range(60)]
    sets += [(60 + i, "s", list("abc")) for i in range(8)]
    q = spark.createDataFrame([(i, s, k, i) for i, s, k in sets], "qid long, scope string, kw array<string>, seq long")
    lessons = q.withColumnRenamed("qid", "lid")

    def rel(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 0

    for scoped in (True, False):
        got = {(r.qid, r["rank"]): (r.lid, r.relevance) for r in S.recall(q.drop("seq"), lessons, 3, 0.25, scoped).collect()}
        want = {}
        for i, s, k in sets:
            ranked = sorted(((rel(k, k2), j) for j, s2, k2 in sets if j != i and (s == s2 or not scoped) and rel(k, k2) >= 0.25), reverse=True)
            want |= {(i, n + 1): (j, round(x, 4)) for n, (x, j) in enumerate(ranked[:3])}
        assert got == want
    corpus = q.withColumn("kw_err", F.col("kw"))
    reached = {(r.key, r.scoped): (r.reached, r.cross_scope) for r in S.reach(corpus).collect()}
    for scoped in (True, False):
        hits = [[s2 for j, s2, k2 in sets if j != i and (s == s2 or not scoped) and rel(k, k2) >= 0.25 and k] for i, s, k in sets]
        want = (sum(bool(h) for h in hits), sum(any(x != s for x in h) for h, (_, s, _) in zip(hits, sets)))
        assert reached["question", scoped] == want


def test_approximate_recall_finds_most(spark):
    import random
    rnd = random.Random(3)
    base = [rnd.sample([f"w{i}" for i in range(500)], 30) for _ in range(60)]
    sets = [(2 * i, "s", b) for i, b in enumerate(base)] + [(2 * i + 1, "s", b[:27] + ["x", "y", f"z{i}"]) for i, b in enumerate(base)]
    q = spark.createDataFrame([(i, s, k, i) for i, s, k in sets], "qid long, scope string, kw array<string>, seq long")
    exact = {(r.qid, r.lid) for r in S.recall(q.drop("seq"), q.withColumnRenamed("qid", "lid"), 1, 0.5).collect()}
    near = {(r.qid, r.lid) for r in S.recall_approx(q, q.withColumnRenamed("qid", "lid"), 1, 0.5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_approximate_recall_in_hot_buckets_and_scopes(spark, monkeypatch):
    """Few candidates among unlike sets, every near copy of a large group, none across scopes."""
    import random
    rnd = random.Random(6)
    monkeypatch.setattr(S, "HOT", 8)
    group = rnd.sample(range(400), 40)
    sets = [(i, "xy"[i % 2], [f"w{w}" for w in ([*group[:39], 500 + i] if i < 60 else rnd.sample(range(400), 30))]) for i in range(200)]
    q = spark.createDataFrame([(i, s, k, i) for i, s, k in sets], "qid long, scope string, kw array<string>, seq long")
    lessons = q.withColumnRenamed("qid", "lid")
    exact = {(r.qid, r.lid, r.relevance) for r in S.recall(q.drop("seq"), lessons, 3, 0.25).collect()}
    near = {(r.qid, r.lid, r.relevance) for r in S.recall_approx(q, lessons, 3, 0.25).collect()}
    assert len(exact & near) >= 0.9 * len(exact) and {x for x in exact if x[0] < 60} <= near
    again = q.union(q)
    assert {(r.qid, r.lid, r.relevance) for r in S.recall_approx(again, again.withColumnRenamed("qid", "lid"), 3, 0.25).collect()} == near
    nodes, _ = S.nodes_of(q.select(F.col("qid").alias("id"), "scope", "kw"))
    far = nodes.where("node IS NOT NULL").limit(0)
    assert S.minhash_links(far, 0.25, 4).count() == 0


def test_running_sums_of_any_doubles(spark):
    """Sums that six decimals cannot hold, next to ones that they do."""
    import math

    values = {"fine": [4e-7, 4e-7, 4e-7, None, 1e-12], "large": [1e33, 1.0, -1e33, 5e32], "cents": [0.1, 0.2, None, 0.3, 0.4, 1e6 + 0.01], "odd": [1.0, math.inf, 2.0], "none": [None, None],
              "huge": [9e31, 9e31, 9e31], "late": [0.1, 0.2, 1e-9]}
    rows = [(g, i, v) for g, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {}
    for r in ordered_scan(df, ["g"], ["i"], seq=None, sums={"s": F.col("v")}, n_slices=7).orderBy("g", "i").collect():
        got.setdefault(r.g, []).append(r.s)
    assert got["none"] == [None, None] and got["odd"] == [1.0, math.inf, math.inf]
    assert got["cents"] == [0.1, 0.3, 0.3, 0.6, 1.0, 1000001.01]
    for g in ("fine", "large", "huge", "late"):
        so_far = 0.0
        for v, s in zip(values[g], got[g], strict=True):
            so_far += v or 0.0
            assert math.isclose(s, so_far, rel_tol=1e-12, abs_tol=1e17 if g == "large" else 1e-18), (g, got[g])


def _walk(rows):
    """Positions, depths and subtree sizes by a walk from the roots."""
    ids = {(r, s) for r, s, _ in rows}
    children = {}
    for r, s, p in rows:
        children.setdefault((r, p if (r, p) in ids else None), []).append(s)
    out = {}
    for run in {r for r, _, _ in rows}:
        n, stack, order = 0, [(s, 0) for s in sorted(children.get((run, None), []), reverse=True)], []
        while stack:
            s, depth = stack.pop()
            n += 1
            order.append((s, depth))
            out[run, s] = [n, depth, 0]
            stack += [(c, depth + 1) for c in sorted(children.get((run, s), []), reverse=True)]
        for i, (s, depth) in enumerate(order):
            out[run, s][2] = next((j for j in range(i + 1, len(order)) if order[j][1] <= depth), len(order)) - i - 1
    return {k: tuple(v) for k, v in out.items()}


def test_preorder_equals_a_walk(spark):
    import random
    rnd, rows = random.Random(8), []
    for run in ["a", "b", None, "wide", "chain"]:
        n = {"wide": 60, "chain": 60}.get(run, 40)
        for s in range(n):
            parent = 0 if run == "wide" and s else s - 1 if run == "chain" else rnd.choice([None, *range(s), 999]) if s else None
            rows.append((run, s, parent))
    rows += [("ring", 1, 2), ("ring", 2, 1), ("ring", 3, 2), ("ring", 4, None), ("ring", 5, 4)]
    df = spark.createDataFrame(rows, "run_id string, seq int, parent_seq int").repartition(3)
    out, rounds = FO.preorder(df)
    assert {(r.run_id, r.seq): (r.position, r.depth, r.below) for r in out.collect()} == _walk(rows) and rounds <= 10
    assert FO.preorder(df.limit(0))[0].count() == 0


def test_preorder_of_a_very_deep_chain(spark):
    n = 100_000
    chain = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), (F.col("id") - 1).alias("parent_seq"))
    out, rounds = FO.preorder(chain)
    assert rounds <= 20
    got = out.agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.count_if(F.col("position") != F.col("seq") + 1).alias("bad"), F.count_if(F.col("below") != n - 1 - F.col("seq")).alias("under")).first()
    assert (got.n, got.d, got.bad, got.under) == (n, n - 1, 0, 0)


def test_preorder_of_small_runs_needs_no_rounds(spark):
    """Runs that fit are ranked on arrays, whatever a batch holds; the others by rounds, beside them."""
    import random
    rnd, rows = random.Random(9), []
    for run in [None, "", *(f"r{i}" for i in range(30)), "chain", "wide"]:
        n = 70 if run in (None, "chain", "wide") else rnd.randrange(1, 20)
        names = rnd.sample(range(-2**31, 2**31 - 1), n)
        for i, s in enumerate(names):
            parent = names[0] if run == "wide" else names[i - 1] if run == "chain" else rnd.choice([None, 2**40, *names[:i]])
            rows.append((run, s, parent if i else None))
    rows += [("ring", 1, 2), ("ring", 2, 1), ("ring", 3, 2), ("ring", 4, None), ("ring", 5, 4), ("alone", 1, 1)]
    want = _walk(rows)
    df = spark.createDataFrame(rows, "run_id string, seq int, parent_seq long").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch, whole in ((before, FO.WHOLE), ("7", FO.WHOLE), ("1", 69), ("7", 0)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            out, rounds = FO.preorder(df, whole)
            got = out.collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert {(r.run_id, r.seq): (r.position, r.depth, r.below) for r in got} == want and len(got) == len(want)
        assert rounds == 0 if whole == FO.WHOLE else 0 < rounds <= 12


def test_span_tree_is_that_of_the_spans(spark, t):
    from tessera.plans import derived as D
    tree, rounds = FO.preorder(D.span_tree(t.events))
    rows = [(r.run_id, r.seq, r.parent_seq) for r in D.spans(t.events).select("run_id", "seq", "parent_seq").collect()]
    assert rounds == 0 and {(r.run_id, r.seq): (r.position, r.depth, r.below) for r in tree.collect()} == _walk(rows)


def test_estimates_of_rounds_stay_small(spark):
    """Spark plans each join by estimated sizes; their digits must not grow with the rounds."""
    chain = spark.range(1024).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), (F.col("id") - 1).alias("parent_seq"))
    out, rounds = FO.preorder(chain, 0)
    size = out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    assert rounds >= 11 and size < 1000


def test_suites_are_graded_side_by_side(spark, t):
    """200 pairs over a few query texts; one that fails, while it runs, is charged alone."""
    from tessera.plans import keys_grd as G
    t.customer.createOrReplaceTempView("customer")
    pairs = [(f"p{i}", f"SELECT count(*) + {i % 20} FROM customer", "SELECT count(c_custkey) FROM customer") for i in range(198)]
    pairs += [("bad", "SELECT raise_error('no') FROM customer", "SELECT count(c_custkey) FROM customer"), ("none", " ", "SELECT 1")]
    spark.sparkContext.setLogLevel("OFF")
    rows = {r.pair: (r.correct, r.reason) for r in G.grade_suite(spark, pairs).collect()}
    spark.sparkContext.setLogLevel("ERROR")
    assert len(rows) == 200
    assert [k for k, v in rows.items() if v[0]] == [f"p{i}" for i in range(0, 198, 20)]
    assert rows["bad"][1] == "query failed" and rows["none"][1] == "no query produced"
    assert {v[1] for k, v in rows.items() if k.startswith("p")} == {"match", "same row count, different values"}


def test_a_query_of_many_pairs_runs_once(spark, t, monkeypatch):
    t.customer.createOrReplaceTempView("customer")
    runs, asked = C.QueryRuns(spark), []
    real = spark.sql
    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **b: (asked.append(q), real(q, *a, **b))[1])
    for _ in range(3):
        assert C.execution_accuracy(spark, "SELECT 1 AS x", "SELECT 2 AS y", runs=runs)[1].startswith("same row count")
        assert C.execution_accuracy(spark, "SELECT nope", "SELECT 2 AS y", runs=runs)[1].startswith("query failed")
    assert sorted(asked) == ["SELECT 1 AS x", "SELECT 2 AS y", "SELECT nope"]
