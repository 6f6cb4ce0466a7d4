"""Fewest hops against a plain breadth-first search."""

import random
from collections import deque

from pyspark.sql import functions as F

from tessera.operators.paths import _dealt, shortest_paths


def by_hand(edges, sources):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = set()
    for s in sources:
        hops, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y in near.get(x, ()):
                if y not in hops:
                    hops[y] = hops[x] + 1
                    queue.append(y)
        out |= {(s, y, h, min(x for x in near[y] if hops.get(x) == h - 1)) for y, h in hops.items() if h}
    return out


def test_paths_with_hubs_cycles_loops_and_long_chains(spark):
    draw = random.Random(9)
    edges = [("hub", f"n{i}") for i in range(300)] + [(f"n{draw.randrange(300)}", f"m{draw.randrange(200)}") for _ in range(400)]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("c0", "hub"), ("c9", "hub")]  # a cycle through the hub
    edges += [("n1", "n1"), ("m1", "n2"), ("n2", "m1"), ("far", "away"), ("hub", "n0")]  # loops, both ways, another part, a repeat
    sources = ["hub", "m3", "far", "nowhere", "c4", "c4"]
    got = shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(s,) for s in sources], "node string"))
    rows = [tuple(r) for r in got.select("source", "node", "hops", "via").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == by_hand(edges, set(sources))


def test_paths_without_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert shortest_paths(none, spark.createDataFrame([("a",)], "node string")).count() == 0


def test_a_round_deals_only_its_frontier(spark):
    """The edges stay where they were dealt; before, each round dealt all of them again."""
    edges = _dealt(spark.createDataFrame([("hub", f"n{i}") for i in range(64)], "src string, dst string"))
    assert {r.src: r.n for r in edges.groupBy("src").agg(F.countDistinct("slot").alias("n")).collect()}["hub"] > 4
    ahead = spark.createDataFrame([("hub", 1), ("n3", 2)], "src string, slot int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ahead.join(edges, ["src", "slot"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1
