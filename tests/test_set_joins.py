"""Block grids of the set join and the 2-gram lookup of stored values, against all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import qgrams, setgrid
from tessera.operators import similarity as M
from tessera.operators import values as V


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _corpus(n=160, seed=2, scopes=("x", "x", "x", "y", None)):
    """Sets in which a few words are very common, with copies and empty sets."""
    rnd = random.Random(seed)
    common, rare = [f"c{chr(97 + i)}" for i in range(12)], [f"r{i}" for i in range(300)]
    rows = []
    for i in range(n):
        kw = {w for w in common if rnd.random() < 0.5} | set(rnd.sample(rare, rnd.choice([0, 1, 3, 10, 30])))
        if i % 10 == 9:
            kw = set(rows[rnd.randrange(i)][2])
        if i % 40 == 7:
            kw = set(rnd.sample(rare, 5))
        rows.append((i, rnd.choice(scopes), sorted(kw) if i % 31 else [], i * 7 % 97))
    return rows


@pytest.mark.parametrize(("hot", "block"), [(1, 7), (8, 16), (10_000, 16)])
def test_links_of_both_ways_equal_all_pairs(spark, monkeypatch, hot, block):
    monkeypatch.setattr(M, "HOT", hot)
    monkeypatch.setattr(setgrid, "BLOCK", block)
    rows = _corpus()
    sets = spark.createDataFrame(rows, "id long, scope string, kw array<string>, seq long")
    nodes, members = M.nodes_of(sets)
    of = {}
    for r in members.collect():
        of.setdefault(r.node, []).append(r.id)
    kw = {r[0]: frozenset(r[2]) for r in rows}
    node = {n: (kw[ids[0]], next(r[1] for r in rows if r[0] == ids[0])) for n, ids in of.items()}
    for scoped in (True, False):
        want = {(a, b): _jaccard(node[a][0], node[b][0]) for a in node for b in node if a < b and (not scoped or node[a][1] is not None and node[a][1] == node[b][1])}
        want = {k: v for k, v in want.items() if v >= 0.25}
        got = M.node_pairs(nodes, 0.25, scoped).collect()
        assert len(got) == len({(r.a, r.b) for r in got})
        assert {(r.a, r.b): r.relevance for r in got} == want


def test_recall_and_reach_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT", 5)
    monkeypatch.setattr(setgrid, "BLOCK", 16)
    rows = _corpus(120, 4, ("x", "x", "y"))
    c = spark.createDataFrame(rows, "qid long, scope string, kw array<string>, seq long")
    got = {}
    for r in M.recall(c.select("qid", "scope", "kw"), c.select(F.col("qid").alias("lid"), "scope", "kw", "seq"), 3, 0.25).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.lid, r.relevance))
    for q, s, kw, _ in rows:
        near = [(_jaccard(set(kw), set(k2)), seq, i) for i, s2, k2, seq in rows if i != q and s2 == s and kw and k2]
        near = sorted((x for x in near if x[0] >= 0.25), reverse=True)[:3]
        assert sorted(got.get(q, [])) == [(n + 1, i, round(rel, 4)) for n, (rel, _, i) in enumerate(near)]
    linked = [(i, j) for i, s, a, _ in rows for j, _, b, _ in rows if i != j and a and b and _jaccard(set(a), set(b)) >= 0.25]
    scope = {r[0]: r[1] for r in rows}
    reach = {(r.key, r.scoped): (r.reached, r.cross_scope) for r in M.reach(c.withColumn("kw_err", F.col("kw"))).collect()}
    assert reach["question", True] == (len({i for i, j in linked if scope[i] == scope[j]}), 0)
    assert reach["question", False] == (len({i for i, j in linked}), len({i for i, j in linked if scope[i] != scope[j]}))
    rates = [20, 100]
    teaches = {r.rate: {x.qid for x in c.where(M.produces_lesson(F.col("qid"), r.rate)).collect()} for r in spark.createDataFrame([(x,) for x in rates], "rate int").collect()}
    seq = {r[0]: r[3] for r in rows}
    got = {r.rate: r.reached for r in M.prequential_reach(c, rates).collect()}
    assert got == {r: len({i for i, j in linked if scope[i] == scope[j] and j in teaches[r] and seq[j] < seq[i]}) for r in rates}


def test_overlaps_are_exact(monkeypatch):
    rnd = np.random.default_rng(3)
    a, b = ([np.unique(rnd.zipf(1.3, rnd.integers(0, 60)) % 500) for _ in range(n)] for n in (40, 33))
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    for dense, columns, expanded in ((1, 7, 10), (50, 64, 100), (10**9, 64, 10**6)):
        monkeypatch.setattr(setgrid, "DENSE", dense)
        monkeypatch.setattr(setgrid, "COLUMNS", columns)
        monkeypatch.setattr(setgrid, "EXPANDED", expanded)
        assert setgrid.overlaps(a, b).astype(int).tolist() == want
    assert setgrid.overlaps([], []).shape == (0, 0) and setgrid.overlaps([np.zeros(0, int)], [np.array([1])]).tolist() == [[0]]


def test_what_a_meeting_keeps():
    rel = np.array([[0.5, 0.9, 0.5, -1], [-1, -1, 0.3, -1]])
    by = {"v": np.array([3.0, 1.0, 4.0, 9.0])}
    assert setgrid.keep_best(2, "v")(rel, {}, by).tolist() == [[False, True, True, False], [False, False, True, False]]
    assert setgrid.keep_best(1, "v")(rel, {}, {"v": np.array([3.0, np.nan, 3.0, 1.0])}).tolist() == [[True, False, True, False], [False, False, True, False]]
    assert setgrid.keep_least(["v"])(rel, {}, by).tolist() == [[False, True, False, False], [False, False, True, False]]
    own, other = {"v": np.array([1.0, np.nan])}, {"v": np.array([1.0, 2.0, 2.0, 1.0])}
    assert setgrid.keep_inside_and_across("v")(rel, own, other).tolist() == [[True, True, False, False], [False, False, True, False]]


def test_tasks_of_one_scope_are_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(setgrid, "BLOCK", 32)
    rows = [(i, "x", [f"w{j}" for j in range(i % 40, i % 40 + 20)] + ["all"], i) for i in range(900)]
    sets = spark.createDataFrame([(i, s, [*k, f"own{i}"], q) for i, s, k, q in rows], "id long, scope string, kw array<string>, seq long")
    nodes, _ = M.nodes_of(sets)
    met = setgrid.grid(nodes.withColumn("part", F.col("scope")), 0.25).groupBy("i", "j").count().collect()
    assert len(met) > 300 and max(r["count"] for r in met) <= 64 and sorted(r["count"] for r in met)[len(met) // 2] >= 16


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _names(rnd, n):
    parts = ["almond", "antique", "azure", "beige", "bisque", "black", "blue", "burly", "chiffon", "coral", "cream", "dark", "deep", "dodger", "drab", "firebrick"]
    return sorted({" ".join(rnd.sample(parts, rnd.choice([1, 2, 3]))) + rnd.choice(["", f" {rnd.randint(0, 99)}"]) for _ in range(n)})


@pytest.mark.parametrize("index_from", [0, 100_000])
def test_closest_values_equal_all_pairs(spark, monkeypatch, index_from):
    monkeypatch.setattr(qgrams, "INDEX_FROM", index_from)
    monkeypatch.setattr(qgrams.near, "__defaults__", (index_from, None))
    rnd = random.Random(6)
    stored = {"name": [*_names(rnd, 150), "", "x", "xy"], "code": [f"A{i:03d}" for i in range(60)]}
    needles = []
    for col, values in stored.items():
        for v in [*rnd.sample(values, 12), "", "zzzzzzzzzz", "x"]:
            text = list(v)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                text.insert(rnd.randint(0, len(text)), rnd.choice("abz 1")) if rnd.random() < 0.5 or not text else text.pop(rnd.randrange(len(text)))
            needles.append((f"{col}:{len(needles)}", "t", col, "".join(text)))
    d = spark.createDataFrame([("t", c, v, 1) for c, vs in stored.items() for v in vs], "table_name string, column_name string, value string, freq long")
    got = {}
    for r in V.closest(spark.createDataFrame(needles, "needle_id string, table_name string, column_name string, literal string"), d, 6).collect():
        got.setdefault(r.needle_id, []).append((r["rank"], r.value, r.score, r.close))
    for i, _, col, text in needles:
        scored = [(1.0 if not max(len(text), len(v)) else 1 - _levenshtein(text, v) / max(len(text), len(v)), v) for v in stored[col]]
        order = sorted(scored, key=lambda x: (x[0] < 0.4, -x[0] if x[0] >= 0.4 else 0, x[1]))[:6]
        assert [(k, v) for k, v, *_ in sorted(got[i])] == [(k + 1, v) for k, (_, v) in enumerate(order)], (i, text)


def test_few_pairs_of_a_column_are_scored(spark):
    """Misspelt words against all words of the documents of sf 0.1."""
    words = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.explode(F.split(F.lower("text"), "[^a-zäöüß]+")).alias("value")).distinct().where("length(value) > 3")
    names = words.select(F.lit("documents").alias("table_name"), F.lit("text").alias("column_name"), "value").checkpoint()
    few = names.orderBy(F.xxhash64("value")).limit(40)
    needles = few.select(F.col("value").alias("needle_id"), "table_name", "column_name", F.concat(F.substring("value", 1, 4), F.lit("x"), F.expr("substring(value, 6)")).alias("literal"))
    n, scored = names.count(), []
    score = V.similarity(F.col("literal"), F.col("value"))

    def best(df):
        return V._top_k(df, "needle_id", [F.desc("score"), F.col("value")], 12)

    got = best(qgrams.near(needles, names, score, 0.4, best, 12, 0, lambda pairs: scored.append(pairs.count()))).collect()
    want = best(names.join(F.broadcast(needles), ["table_name", "column_name"]).withColumn("score", score).where("score >= 0.4")).collect()
    assert Counter((r.needle_id, r.value, r["rank"]) for r in got) == Counter((r.needle_id, r.value, r["rank"]) for r in want)
    print("scored", sum(scored), "of", n * 40, scored)
    assert sum(scored) < 0.05 * n * 40, (scored, n * 40)


def test_identifiers_by_length_bands(spark):
    names = ["part", "parts", "lineitem", "lineitems", "p", "pa", "customer_addresses", "", "orders"]
    cat = spark.createDataFrame([(t, "c") for t in names if t], "table_name string, column_name string")
    asked = ["prt", "linetem", "q", "customeraddress", "", "ordres", "pp", "lin"]
    problems = spark.createDataFrame([(i, "unknown table", x, "") for i, x in enumerate(asked)], "query_id int, problem string, name string, detail string")
    refs = spark.createDataFrame([], "query_id int, kind string, qualifier string, name string")
    got = {r.query_id: r.suggestion for r in V.closest_identifier(problems, refs, cat).collect()}
    for i, x in enumerate(asked):
        scored = [(1 - _levenshtein(x, t) / max(len(x), len(t)), t) for t in names if t]
        near = sorted((-s, len(t), t) for s, t in scored if s >= 0.6)
        assert got.get(i) == (near[0][2] if near else None), x


def test_a_set_is_sent_to_few_meetings(spark, monkeypatch):
    """Before, a set was sent out once for each 512 others of its scope, tokens and all."""
    monkeypatch.setattr(setgrid, "TILE", 8)
    rnd = random.Random(4)
    rows = [(i, "x", 20, [*range(i % 9, i % 9 + 12), *sorted(rnd.sample(range(100, 900), 8))]) for i in range(1000)]
    nodes = spark.createDataFrame(rows, "node long, part string, n int, toks array<long>")
    assert setgrid.grid(nodes, 0.25).count() <= 1000 * (setgrid.LEAST_BLOCKS + 1)
    got = {(r.a, r.b): r.relevance for r in setgrid.grid_links(nodes, 0.25, setgrid.keep_all, []).collect()}
    sets = [set(r[3]) for r in rows]
    want = {(i, j): _jaccard(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and _jaccard(a, b) >= 0.25}
    assert got == want


def test_two_tiles_equal_all_pairs(monkeypatch):
    rnd = np.random.default_rng(5)
    for many in (0, 16, 10**6):
        monkeypatch.setattr(setgrid, "MANY", many)
        for high, words in ((6, 20), (60, 400), (400, 3000)):
            sets = [[np.unique(rnd.integers(0, words, rnd.integers(1, high))).astype(np.int64) + 2**33 * int(rnd.integers(0, 2)) for _ in range(30)] for _ in range(2)]
            a, b = (setgrid.Tile(setgrid.pack(pa.table({"node": pa.array(range(30)), "toks": pa.array(s, pa.list_(pa.int64()))})), []) for s in sets)
            assert all((a.toks(i) == x).all() for i, x in enumerate(sets[0]))
            got, want = setgrid.tile_relevance(a, b, 0.25), setgrid.relevance(*sets, 0.25)
            assert (want == (-1 if got is None else got)).all()


def _block(sets):
    return setgrid.Block(setgrid.pack_block(pa.table({"node": pa.array(range(len(sets))), "n": pa.array([len(s) for s in sets], pa.int32()), "toks": pa.array(sets, pa.list_(pa.int64()))}), []), [])


def test_two_blocks_equal_all_pairs(monkeypatch):
    rnd = np.random.default_rng(8)
    for long_posting, held in ((1, 1), (25, 1 << 20), (10**6, 7)):
        monkeypatch.setattr(setgrid, "LONG_POSTING", long_posting)
        monkeypatch.setattr(setgrid, "HELD", held)
        for high, exponent in ((6, 2.0), (60, 1.3), (500, 1.2)):
            a, b = ([np.unique(np.r_[rnd.zipf(exponent, rnd.integers(1, high)) % 900, rnd.integers(0, 900, 2)]).astype(np.int64) + 2**40 for _ in range(n)] for n in (50, 67))
            x, y = _block(a), _block(b)
            for p, q, same in ((x, y, False), (y, x, False), (y, y, True)):
                sets = [dict(enumerate(a if z is x else b)) for z in (p, q)]
                want = {(i, j): _jaccard(set(s.tolist()), set(t.tolist())) for i, s in sets[0].items() for j, t in sets[1].items() if not same or i < j}
                got = {}
                for at, to, rel in setgrid.block_links(p, q, 0.25, same):
                    for i, j, r in zip(p.node[at].tolist(), q.node[to].tolist(), rel.tolist(), strict=True):
                        assert (key := tuple(sorted((i, j))) if same else (i, j)) not in got
                        got[key] = r
                assert got == {k: v for k, v in want.items() if v >= 0.25}


@pytest.mark.parametrize("links", ["node", "minhash"])
def test_blocks_are_written_once(spark, monkeypatch, links):
    """Before, each block was dealt out anew for every meeting, so that what was written grew
    with the square of a scope's blocks (sim_reach, sim_recall, sim_recall_approx, sim_prompt_block, sim_prequential_reach)."""
    monkeypatch.setattr(setgrid, "TILE", 8)
    monkeypatch.setattr(setgrid, "BLOCK", 16)
    monkeypatch.setattr(M, "HOT", 3)
    rnd = random.Random(5)
    rows = [(i, "x", sorted({f"w{rnd.randrange(30)}" for _ in range(20)})) for i in range(400)]
    nodes, members = M.nodes_of(spark.createDataFrame(rows, "id long, scope string, kw array<string>"))
    found = M.node_links(nodes, 0.25) if links == "node" else M.minhash_links(nodes, 0.25, 16)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan
    kw = {r[0]: set(r[2]) for r in rows}
    node = {}
    for r in members.collect():
        node.setdefault(r.node, r.id)
    got = {(node[r.a], node[r.b]): r.relevance for r in found.collect()}
    want = {(i, j): _jaccard(kw[i], kw[j]) for i in node.values() for j in node.values() if i != j and _jaccard(kw[i], kw[j]) >= 0.25}
    assert got == want if links == "node" else got.items() <= want.items() and len(got) > 0.9 * len(want)


def test_keywords_of_rows_equal_those_of_columns(spark):
    texts = ["The Kelvin \u212a sign and \u0130STANBUL, \u00c9cole stra\u00dfe ABC_def x1y22zzz aaa aaa AAA", "", None, "a an the", "their \u0438\u0445 \u03a3\u03a3 foo\u03a3bar __ ___ ab\u00e9cde", "x" * 5000 + " tail_word"]
    rows = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in texts for y in ("Source One", None, "aaa tail_word"))]
    docs = spark.createDataFrame(rows, "id int, text string, source string")
    want = docs.select("id", M.keywords(F.col("text")).alias("a"), M.keywords(F.concat("text", F.lit(" "), "source")).alias("b"))
    got = M.keyword_sets(docs, "text", "source").select("id", F.col("kw").alias("a"), F.concat("kw", "more_kw").alias("b"))
    as_sets = lambda df: {r.id: tuple(None if x is None else (len(x), frozenset(x)) for x in (r.a, r.b)) for r in df.collect()}
    assert as_sets(got) == as_sets(want)


def test_numbers_are_by_frequency_among_nodes(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT", 5)
    rows = _corpus(90, 3)
    sets = spark.createDataFrame(rows, "id long, scope string, kw array<string>, seq long")
    nodes, members, numbers = M.nodes_of(sets, True)
    kw = {r[0]: r[2] for r in rows}
    of = {r.node: kw[r.id] for r in members.collect()}
    df = Counter(w for s in of.values() for w in s)
    order = {w: i for i, w in enumerate(sorted(df, key=lambda w: (df[w], w)))}
    got = {r.node: sorted(r.numbers) for r in numbers.collect()}
    ranks = {x: i for i, x in enumerate(sorted({x for s in got.values() for x in s}))}  # numbers rise, with gaps between partitions
    assert {n: [ranks[x] for x in s] for n, s in got.items()} == {n: sorted(order[w] for w in s) for n, s in of.items()}
