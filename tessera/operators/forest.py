"""Depth-first positions in forests of any depth, by list ranking.

Every node is passed twice by a tour that goes around the forest: entered, and left once
all below it has been. What follows a pass is known from the node's neighbours alone (its
first child, its next sibling, its parent), so the tour is one linked list a tree group.
Pointer doubling ranks it: each round every pass adds up the weights as far as its pointer
reaches and takes over the pointer's own, so the distance doubles, and a tour of ``n`` passes
is ranked in ``log2(n)`` rounds, however deep the trees are. A pass is a row of constant
size and is pointed to by one other at most, so no round has a hot key. Counting entries
gives the position, entries less exits the depth, and the difference of a node's two
positions the size of its subtree.

A run of up to ``WHOLE`` nodes needs no joins: runs are dealt by ``run_id``, sorted by ``seq``,
and the same tour is linked and ranked on arrays, a batch of whole runs at a time. Memory is
that of a batch and a run of ``WHOLE``. Larger runs are ranked as rows of a frame.

A node whose parent is not in its group is a root. Nodes on a cycle, and below one, hang on no
root and are left out, as a walk from the roots would.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import bounded
from ..plans.ordered import ordered_scan, same
from ..session import ensure_checkpoint_dir

WHOLE = 1 << 16  # nodes of a run that one task ranks on arrays


def _tour(nodes: DataFrame) -> DataFrame:
    """``run_id, seq, exit, next_seq, next_exit``: each pass and the one that follows it
    (null at the end of a group)."""
    parents = nodes.select(F.col("run_id").alias("_r"), F.col("seq").alias("_p"))
    known = nodes.alias("n").join(parents.alias("p"), (F.col("n.run_id").eqNullSafe(F.col("p._r"))) & (F.col("n.parent_seq") == F.col("p._p")), "left").select(
        "n.run_id", "n.seq", F.col("p._p").alias("parent"))
    ranked = ordered_scan(known, ["run_id", "parent"], ["seq"], seq="_n")
    after = ranked.select(F.col("run_id").alias("_r"), F.col("parent").alias("_p"), (F.col("_n") - 1).alias("_m"), F.col("seq").alias("sibling"))
    placed = ranked.alias("a").join(after.alias("b"), same("a", "b", [("run_id", "_r"), ("parent", "_p"), ("_n", "_m")]), "left").select("a.run_id", "a.seq", "a.parent", "b.sibling")
    child = known.where("parent IS NOT NULL").groupBy("run_id", "parent").agg(F.min("seq").alias("child"))
    full = placed.alias("a").join(child.alias("c"), same("a", "c", [("run_id", "run_id")]) & (F.col("a.seq") == F.col("c.parent")), "left").select("a.*", "c.child")
    entered = F.struct(F.lit(False).alias("exit"), F.coalesce("child", "seq").alias("next_seq"), F.col("child").isNull().alias("next_exit"))
    left = F.struct(F.lit(True).alias("exit"), F.coalesce("sibling", "parent").alias("next_seq"),
                    F.when(F.col("sibling").isNotNull() | F.col("parent").isNotNull(), F.col("sibling").isNull()).alias("next_exit"))
    return full.select("run_id", "seq", F.explode(F.array(entered, left)).alias("x")).select("run_id", "seq", "x.*")


def _starts(run: pa.ChunkedArray) -> np.ndarray:
    """Where each run begins in a sorted column of runs; null is a run of its own."""
    a, b = run.slice(1), run.slice(0, max(len(run) - 1, 0))
    differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return np.r_[0, np.flatnonzero(differ.to_numpy()) + 1]


def _walk(nodes: pa.Table) -> pa.Table:
    """The positions of whole runs, their nodes sorted by run and ``seq``."""
    n, starts = len(nodes), _starts(nodes["run_id"])
    sizes = np.diff(np.r_[starts, n])
    run, seq = np.repeat(np.arange(len(starts)), sizes), nodes["seq"].to_numpy()
    known = nodes["parent_seq"].is_valid().to_numpy()
    wanted = pc.if_else(nodes["parent_seq"].is_valid(), nodes["parent_seq"], nodes["seq"]).to_numpy()
    values = np.unique(seq)
    here, there = np.searchsorted(values, seq), np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    keys, sought = run * len(values) + here, run * len(values) + there
    at = np.minimum(np.searchsorted(keys, sought), n - 1)
    parent = np.where(known & (values[there] == wanted) & (keys[at] == sought), at, n + run)  # roots are children of their run

    # passes: i enters node i, n + i leaves it, 2n is the end
    end = 2 * n
    order = np.argsort(parent, kind="stable")
    opens = np.r_[True, parent[order][1:] != parent[order][:-1]]
    sibling, child = np.full(n, -1), np.full(n, -1)
    sibling[order[:-1]] = np.where(opens[1:], -1, order[1:])
    first = order[opens & (parent[order] < n)]
    child[parent[first]] = first
    nodes_at = np.arange(n)
    after = np.r_[np.where(child >= 0, child, n + nodes_at), np.where(sibling >= 0, sibling, np.where(parent < n, n + parent, end)), end]
    entries, depth = np.r_[np.ones(n, np.int64), np.zeros(n + 1, np.int64)], np.r_[np.ones(n, np.int64), -np.ones(n, np.int64), 0]
    for _ in range(math.ceil(math.log2(2 * sizes.max())) + 1):
        if (after == end).all():
            break
        entries, depth, after = entries + entries[after], depth + depth[after], after[after]
    ranked = after[:n] == end  # what still points somewhere is on a cycle
    total = np.bincount(run[ranked], minlength=len(starts))
    kept = np.flatnonzero(ranked)
    out = nodes.select(["run_id", "seq"]).take(pa.array(kept)).combine_chunks()
    for name, x in (("position", total[run] - entries[:n] + 1), ("depth", -depth[:n]), ("below", entries[:n] - entries[n:end] - 1)):
        out = out.append_column(name, pa.array(x[kept], pa.int64()))
    return out


def _walk_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_walk`` over sorted batches; the last run of a batch waits for the next one."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        last = held[-1].slice(len(held[-1]) - 1) if held else table.slice(0, 0)
        cut = _starts(pa.concat_tables([last, table])["run_id"])[-1] - len(last)
        if held and cut >= 0:
            yield from _walk(pa.concat_tables([*held, table.slice(0, cut)])).to_batches()
            held = [table.slice(cut)]
        elif cut > 0:
            yield from _walk(table.slice(0, cut)).to_batches()
            held = [table.slice(cut)]
        else:
            held.append(table)
    if held:
        yield from _walk(pa.concat_tables(held)).to_batches()


def preorder(nodes: DataFrame, whole: int = WHOLE) -> tuple[DataFrame, int]:
    """``run_id, seq, position, depth, below`` of ``nodes(run_id, seq, parent_seq)``, siblings
    by ``seq``, positions from 1 in each run, and the rounds that runs of more than ``whole``
    nodes took (0: no such run). ``seq`` names a node in its run."""
    ensure_checkpoint_dir(nodes.sparkSession)
    nodes = nodes.select("run_id", "seq", "parent_seq").checkpoint()
    large = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"), F.count("seq").alias("_known")).where(
        (F.col("_n") > whole) | (F.col("_known") < F.col("_n"))).select(F.col("run_id").alias("_r")).checkpoint()
    out, rounds, small = None, 0, nodes
    if not large.isEmpty():
        large = bounded(large)
        held = F.col("run_id").eqNullSafe(F.col("_r"))
        out, rounds = _ranked(nodes.join(large, held, "left_semi").checkpoint())
        small = nodes.join(large, held, "left_anti")
    schema = T.StructType([*small.select("run_id", "seq").schema, *(T.StructField(c, T.LongType()) for c in ("position", "depth", "below"))])
    walked = small.repartition("run_id").sortWithinPartitions("run_id", "seq").mapInArrow(_walk_runs, schema)
    return (walked.unionByName(out) if out is not None else walked), rounds


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written beside the checkpoints and read again. A checkpointed frame keeps the size
    that was estimated for it, a product over all joins so far whose digits double with each
    round, and what was inferred of its rows; a file has a size of its own."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/forest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranked(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``preorder`` of runs of any size, as rows of a frame."""
    step = _tour(nodes)
    # entries and depth from this pass up to the one that the pointer names
    passes = _kept(step.withColumns({"entries": F.when(F.col("exit"), 0).otherwise(1).cast("long"), "depth": F.when(F.col("exit"), -1).otherwise(1).cast("long")}))
    limit, rounds = math.ceil(math.log2(max(2 * nodes.count(), 2))) + 1, 0
    while rounds < limit and not passes.where("next_seq IS NOT NULL").isEmpty():
        ahead = passes.select(F.col("run_id").alias("_r"), F.col("seq").alias("_s"), F.col("exit").alias("_e"), F.col("next_seq").alias("_ns"),
                              F.col("next_exit").alias("_ne"), F.col("entries").alias("_en"), F.col("depth").alias("_d"))
        moving = passes.where("next_seq IS NOT NULL").alias("a").join(ahead.alias("b"), same("a", "b", [("run_id", "_r"), ("next_seq", "_s"), ("next_exit", "_e")])).select(
            "run_id", "seq", "exit", F.col("_ns").alias("next_seq"), F.col("_ne").alias("next_exit"), (F.col("entries") + F.col("_en")).alias("entries"), (F.col("depth") + F.col("_d")).alias("depth"))
        passes = _kept(passes.where("next_seq IS NULL").unionByName(moving))
        rounds += 1
    ranked = passes.where("next_seq IS NULL")  # what still points somewhere is on a cycle
    both = ranked.groupBy("run_id", "seq").agg(F.max(F.when(~F.col("exit"), F.col("entries"))).alias("_in"), F.max(F.when(F.col("exit"), F.col("entries"))).alias("_out"),
                                               F.max(F.when(~F.col("exit"), F.col("depth"))).alias("_d"))
    total = both.groupBy("run_id").agg(F.max("_in").alias("_total"))
    out = both.alias("a").join(total.alias("t"), same("a", "t", [("run_id", "run_id")])).select(
        "a.run_id", "a.seq", (F.col("_total") - F.col("_in") + 1).alias("position"), (-F.col("_d")).alias("depth"), (F.col("_in") - F.col("_out") - 1).alias("below"))
    return out, rounds
