"""PTH — fewest-hop paths over an undirected edge table, and the join along a path.

Breadth-first frontier loop: each round joins the frontier to the edges,
removes visited nodes with ``left_anti`` and keeps one row per new node (its
lexically smallest predecessor, ``min``: a partial aggregate, so a hub's
neighbours are combined before the shuffle). As edges go both ways, a neighbour of the
frontier is in it, in the one before or new, so only these two are looked through and a
round costs what its frontier does. The edges are dealt once, by (source node, slot of the
other end), so that a hub's neighbours lie in several tasks; a round deals only its frontier,
a row for each slot, and reads the edges where they are. Lineage is cut every round with a
reliable ``checkpoint`` (into ``spark.checkpoint.dir``) of the new nodes alone, so
a lost executor replays at most one round; the loop ends when the frontier is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions

SLOTS = 8


def undirected(edges: DataFrame) -> DataFrame:
    """(src, slot, dst) both ways, each once, dealt and sorted by (src, slot)."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = edges.select(F.explode(ends).alias("x")).select("x.src", F.pmod(F.xxhash64("x.dst"), F.lit(SLOTS)).cast("int").alias("slot"), "x.dst")
    return both.repartition(shuffle_partitions(edges.sparkSession), "src", "slot").distinct().sortWithinPartitions("src", "slot")


def _dealt(edges: DataFrame) -> DataFrame:
    """``undirected`` edges written down. A checkpoint keeps how its rows are dealt and
    sorted only without adaptive execution, which is off for this one job."""
    conf, adaptive = edges.sparkSession.conf, "spark.sql.adaptive.enabled"
    ensure_checkpoint_dir(edges.sparkSession)
    was = conf.get(adaptive)
    conf.set(adaptive, "false")
    try:
        return undirected(edges).checkpoint()
    finally:
        conf.set(adaptive, was)


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """sources(node) → (source, node, hops, via) for every reachable node; the source
    itself is not reported (same node → no row)."""
    e = _dealt(edges)
    slots = F.explode(F.array(*[F.lit(i) for i in range(SLOTS)]))
    frontier = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")).distinct().checkpoint()
    start = before = frontier
    found, h = [], 0
    while True:
        h += 1
        ahead = frontier.select("source", F.col("node").alias("src"), slots.alias("slot"))
        nxt = (ahead.join(e, ["src", "slot"]).select("source", F.col("dst").alias("node"), F.col("src").alias("via"))
               .groupBy("source", "node").agg(F.min("via").alias("via"))
               .join(frontier.select("source", "node").union(before.select("source", "node")), ["source", "node"], "left_anti")
               .withColumn("hops", F.lit(h))).checkpoint()
        if nxt.isEmpty():
            break
        found.append(nxt)
        before, frontier = frontier, nxt
    if not found:
        return start.limit(0).select("source", "node", "hops", "via")
    return reduce(lambda a, b: a.unionByName(b), found).select("source", "node", "hops", "via")


def join_along(tables: dict[str, DataFrame], path: list[tuple[str, str, str, str]]) -> DataFrame:
    """Fold of equi-joins along ``[(left_table, left_col, right_table, right_col), …]``."""
    out = tables[path[0][0]]
    for _, lcol, rtab, rcol in path:
        out = out.join(tables[rtab], F.col(lcol) == F.col(rcol))
    return out


def route(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """``paths`` of :func:`shortest_paths` and targets(source, node) → the steps of each
    path: (source, target, step, src, dst), step 1 leaving the source. Walks back from
    the target, one equi-join per hop; a target that is not reachable has no steps."""
    at = targets.select("source", F.col("node").alias("target"), F.col("node").alias("dst"))
    steps = None
    while True:
        hop = (at.join(paths.select("source", F.col("node").alias("dst"), F.col("hops").alias("step"), F.col("via").alias("src")), ["source", "dst"])
               .select("source", "target", "step", "src", "dst").checkpoint())
        steps = hop if steps is None else steps.unionByName(hop)
        at = hop.where(F.col("step") > 1).select("source", "target", F.col("src").alias("dst"))
        if at.isEmpty():
            return steps


def join_path(references: DataFrame, source: str, target: str) -> list[tuple[str, str, str, str]]:
    """Join conditions ``(left_table, left_col, right_table, right_col)`` along the
    shortest path between two tables of ``references(table, column, ref_table,
    ref_column)``; empty if there is none. Of several references between two tables,
    the lexically smallest counts. The result is as long as the path."""
    spark = references.sparkSession
    both = references.select(F.col("table").alias("src"), F.col("column").alias("src_col"), F.col("ref_table").alias("dst"), F.col("ref_column").alias("dst_col")).unionByName(
        references.select(F.col("ref_table").alias("src"), F.col("ref_column").alias("src_col"), F.col("table").alias("dst"), F.col("column").alias("dst_col")))
    paths = shortest_paths(both.select("src", "dst"), spark.createDataFrame([(source,)], "node string"))
    steps = route(paths, spark.createDataFrame([(source, target)], "source string, node string"))
    on = both.groupBy("src", "dst").agg(F.min(F.struct("src_col", "dst_col")).alias("on"))
    return [(r.src, r.on.src_col, r.dst, r.on.dst_col) for r in steps.join(on, ["src", "dst"]).orderBy("step").collect()]
