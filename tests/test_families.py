"""Operator families on small inputs: TXT, VOT, VAL, PRO, SMP, SIM, OPS."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.operators import sampling as S
from tessera.operators import text as TX
from tessera.operators import values as V
from tessera.operators import voting as VO


def test_tool_call_forms(spark):
    replies = ['<tool_call>{"name": "a", "arguments": {"x": 1}}</tool_call>', '<tool_call>{"name": "a", "parameters": {"x": 2}}',
               '```json\n[{"function": {"name": "b", "arguments": "{\\"y\\": 3}"}}, {"name": "c"}]', '```\n{"name": "d", "arguments": "not json"}\n```',
               '{"name": "e", "arguments": [1]}', "plain prose {", "", None, '{"arguments": {}}', '[1, {"name": "f", "parameters": "{}"}]']
    df = spark.createDataFrame(list(enumerate(replies)), "i int, reply string")
    got = sorted((r.i, r.call_no, r.tool, r.arguments) for r in TX.tool_calls(df).collect())
    assert got == [(0, 0, "a", '{"x":1}'), (1, 0, "a", '{"x":2}'), (2, 0, "b", '{"y":3}'), (2, 1, "c", "{}"), (3, 0, "d", "{}"), (4, 0, "e", "{}"), (9, 1, "f", "{}")]


def test_feedback_with_schema_hints(spark):
    att = spark.createDataFrame([("a", 1, 1, False, "no such column: q", "both", True, None), ("a", 1, 2, False, "boom", "execution", True, None), ("a", 2, 1, True, None, "critique", False, "weak"),
                                 ("a", 3, 1, False, "e", "none", True, None)], "arm string, question_id long, attempt_no int, ok boolean, error string, mode string, review_clean boolean, review_text string")
    refs = spark.createDataFrame([("k", "table", None, "t"), ("k", "column", None, "q"), ("k", "column", "z", "r")], "query_id string, kind string, qualifier string, name string")
    catalog = spark.createDataFrame([("t", "c")], "table_name string, column_name string")
    lines = VO.schema_hints(V.check_refs(refs, catalog)).first().hint
    assert lines == "Schema: unknown column q (in scope)\nSchema: unknown qualifier z (t)"
    hints = spark.createDataFrame([("a", 1, 1, lines)], "arm string, question_id long, attempt_no int, hint string")
    got = {(r.question_id, r.attempt_no): r.feedback for r in VO.feedback(att, hints).collect()}
    assert got[1, 1].endswith(lines) and got[1, 2] == "The query failed: boom\nHint: check table and column names." and got[2, 1] == "weak" and got[3, 1] is None


def test_closest_equals_brute_force(spark):
    rnd = random.Random(1)
    values = sorted({"".join(rnd.choices("abc", k=rnd.randint(0, 9))) for _ in range(120)})
    needles = [(f"n{i}", "t", "c", "".join(rnd.choices("abc", k=rnd.randint(0, 12)))) for i in range(15)]
    d = spark.createDataFrame([("t", "c", v, 1) for v in values], "table_name string, column_name string, value string, freq int")
    n = spark.createDataFrame(needles, "needle_id string, table_name string, column_name string, literal string")
    scored = n.crossJoin(d.select("value")).withColumn("s", V.similarity(F.col("literal"), F.col("value")))
    want = {}
    for r in scored.collect():
        want.setdefault(r.needle_id, []).append((0 if r.s >= 0.4 else 1, -r.s if r.s >= 0.4 else 0, r.value))
    got = {}
    for r in V.closest(n, d, 5, 0.4).orderBy("rank").collect():
        got.setdefault(r.needle_id, []).append(r.value)
    assert got == {k: [x[2] for x in sorted(v)[:5]] for k, v in want.items()}


def test_column_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (None, "a", [1.0, 2.0]), (2, None, None)], "x int, y string, z array<double>")
    got = {(r.table_name, r.column_name): (r.null_count, r.n_distinct) for r in P.column_profile({"t": df, "e": df.limit(0)}).collect()}
    assert got == {("t", "x"): (1, 2), ("t", "y"): (1, 1), ("t", "z"): (1, 1), ("e", "x"): (0, 0), ("e", "y"): (0, 0), ("e", "z"): (0, 0)}


def test_sample_sizes_are_exact_and_limited_before_the_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("s"))
    for n in (0, 1, 10, 999, 5000):
        assert S.stratified_sample(df, "s", "id", n, 3).count() == min(n, 1000)
    plan = S.stratified_sample(df, "s", "id", 10, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_only_the_least_hashes_of_a_stratum_are_dealt(spark, monkeypatch):
    """The draws of every seed as by plain ranking, with keys that come often and null keys;
    before, each row went through the shuffle once for each seed."""
    rows = [(i if i % 10 else 7, "ab"[i % 3 == 0]) for i in range(6000)] + [(None, "a"), (5, None), (1, "c")]
    df = spark.createDataFrame(rows, "key long, s string")
    sizes = {s: sum(x == s for _, x in rows) for s in "abc"}
    seats = {r.stratum: r.seats for r in S.apportion(spark.createDataFrame(list(sizes.items()), "stratum string, size long"), 300).collect()}

    def least(seed, s):
        of = [(hashlib.md5(f"{seed}:{k}".encode()).hexdigest() if k is not None else "", k or 0) for k, x in rows if x == s]
        return [(k if h else None, s) for h, k in sorted(of)[:seats[s]]]

    for spare in (S.SPARE, 0.0):  # without spare hashes, strata have to be read again
        monkeypatch.setattr(S, "SPARE", spare)
        got = Counter((r.key, r.stratum) for r in S._draws(df, "s", "key", 300, [3, 4]).collect())
        assert got == Counter(x for seed in (3, 4) for s in sizes for x in least(seed, s))
