"""MinHash near-duplicates by a multi-index Hamming join.

Each document is its set of 5-word shingles (64-bit hashes) and a signature of
``SYMBOLS`` MinHash symbols of 32 bits. Documents with the same set are one node from
the start. Nodes link if 100 * intersection >= 75 * union; a Jaccard of 0.75 leaves
about 16 of 64 symbols different, and every pair at signature distance <= ``DISTANCE``
(31) is guaranteed to be enumerated, then confirmed on the full sets.

Enumeration splits signatures by pigeonhole, at two grains:

* chunks of one symbol, no error. A pair within the distance agrees on 33 symbols or
  more. A symbol bucket of up to ``LIGHT`` nodes is *light*. A node with at most 32
  symbols in larger buckets therefore shares a light bucket with every partner.
* the remaining nodes (groups of thousands of near copies, texts made mostly of a
  shared passage) are split into chunks of four symbols; one of the 16 chunks has at
  most one error, so keys of three symbols (each error position left out) meet every
  such pair.

No bucket is expanded into all its pairs. First every node is compared with a few
bucket representatives (linear in the nodes), and what links is joined into components.
After that only buckets that still hold several components are looked at. Light ones
give the pairs between their different components (a pair inside one cannot change
it). Nodes that meet through keys of three symbols form clusters; a cluster is dealt
into blocks of ``BLOCK`` nodes, each pair of blocks is one task that compares full sets
by a matrix product and returns no more links than join its nodes, so neither rows nor
a task's memory grow with the square of a group.

Defined cases: a text with fewer than five words is one shingle, its whole word
sequence; without words, or null, it has an empty set, links with nothing and is its
own component. Repeated rows and ids share a component through their equal sets. A
null id never is the smallest; a group of null ids only has a null component and all
are kept. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, extended, forget, is_plain_read, row_number, staged

WORDS = 5
SYMBOLS = 64
DISTANCE = 31
CHUNK = 4
LIGHT = 32
PERCENT = 75
ROUNDS = 2
VOTES = 16
BLOCK = 256
COLUMNS = 16_384
MAX_BROADCAST_NODES = 500_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)[:, None]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 17)
        _powers = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))))
                        for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers[0][:n], _powers[1][:n]


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    b = np.frombuffer((text or b"").lower(), dtype=np.uint8)
    space = _SPACE[b]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1]))) if len(b) else np.zeros(0, int)
    if not len(first):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
    up, down = _power(len(b))
    total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[b] * up)))
    word = _mix((total[last + 1] - total[first]) * down[first])
    k = min(words, len(word))
    n = len(word) - k + 1
    out = np.full(n, int(_PLACE[WORDS]) * k % (1 << 64), np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE) + _mix(word[j:j + n] + _PLACE[j])
    return np.unique(_mix(out))


def signature(x: np.ndarray) -> np.ndarray:
    """32-bit symbols of the shingles that are least under each permutation."""
    least = np.full(SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[None, i:i + 1024] * _MUL + _ADD).min(axis=1), out=least)
    return (least & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def set_key(x: np.ndarray) -> bytes:
    """128-bit key of a shingle set."""
    return struct.pack("<QQ", int(_mix(x + np.uint64(len(x))).sum()), int(_mix(x ^ _M2).sum()))


def sketch(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_shingles, set_key, signature`` (key and signature null for an
    empty set) of ``docs(row, doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, signatures = [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                x = shingles(text)
                n.append(len(x))
                keys.append(set_key(x) if len(x) else None)
                signatures.append(signature(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))],
                names=["row", "doc_id", "n_shingles", "set_key", "signature"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, extended([docs.schema["row"], docs.schema["doc_id"]], "n_shingles long, set_key binary, signature array<int>"))


def _confirmed(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that link: within the signature distance, then on full sets."""
    sig = nodes.select("node", "n_shingles", "signature")
    near = (pairs.join(sig.toDF("a", "na", "sa"), "a").join(sig.toDF("b", "nb", "sb"), "b")
            .where((100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
                   & (F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x != y), lambda x: x)) <= DISTANCE)).select("a", "b"))
    near = staged(near, "near")
    needed = near.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    told = staged(texts.join(bounded_broadcast(needed, MAX_BROADCAST_NODES), "row"), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, left = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("ta").cast(pa.binary()).to_pylist(),
                               batch.column("tb").cast(pa.binary()).to_pylist(), strict=True):
                if a != of:
                    of, left = a, shingles(x)
                right = shingles(y)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = near.join(told.toDF("b", "tb"), "b").join(told.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    links = staged(both.mapInArrow(run, "a long, b long"), "links")
    forget(near, told)
    return links


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node that has a link. Labels
    fall to the least neighbour's, then to their own label's label, until none moves."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    first = labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    last = None
    while True:
        least = (both.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
                 .join(labels, "node").select("node", F.least("c", "component").alias("c"), F.col("component").alias("old")))
        jump = least.join(labels.toDF("c", "cc"), "c", "left").select("node", F.least("c", F.coalesce("cc", "c")).alias("component"), "old")
        new = staged(jump, "labels")
        if last is not None:
            forget(last)
        last, labels = new, new.drop("old")
        if new.where("component != old").isEmpty():
            forget(both, first)
            return labels


def _grown(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """``labels`` after further links: only links between different components are
    followed, from component to component, so a link is looked at once."""
    if labels is None:
        return components(new)
    a, b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    ends = new.select("a", "b").join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(staged(ends.where("a != b").distinct(), "between")).select(F.col("node").alias("component"), F.col("component").alias("to"))
    first = new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("component", F.col("node"))
    every = labels.select("node", "component").unionByName(first.select("node", "component"))
    return staged(every.join(bounded_broadcast(moved, MAX_BROADCAST_NODES), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``component`` of each member; a node without a link is its own."""
    if labels is None:
        return members.withColumn("component", F.col("node"))
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _still_mixed(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    mixed = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    return members.join(staged(mixed, "mixed"), "key", "left_semi")  # written down, so that a hot key's join side can be split


def _across(members: DataFrame) -> DataFrame:
    """Pairs of different components that meet in so many light buckets as a pair within
    the distance must: all its equal symbols but those in large buckets, of which it has no
    more than either node has."""
    a, b = members.alias("a"), members.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")))
    shared = met.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.least("a.in_large", "b.in_large")).alias("in_large"))
    return shared.where(F.col("n") + F.col("in_large") >= SYMBOLS - DISTANCE).select("a", "b")


def _representatives(members: DataFrame, turn: int) -> DataFrame:
    """For each node the representative, of another component, that most of its buckets
    name, if they are ``VOTES`` or more: this step only saves work, and a pair that shares
    fewer rarely links. A bucket's representative is its least node, under another order
    each turn."""
    order = F.col("node") if not turn else F.xxhash64(F.lit(turn), "node")
    least = staged(members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "component")).alias("r")), "representatives")
    named = members.join(least, "key").where(F.col("component") != F.col("r.component"))
    votes = named.groupBy("node", F.col("r.node").alias("rep")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= VOTES)
    return votes.groupBy("node").agg(F.max_by("rep", F.struct("n", (-F.col("rep")).alias("r"))).alias("rep")).select(
        F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()


def link(texts: DataFrame, nodes: DataFrame, light: int = LIGHT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """``node, component`` of the nodes that have a link."""
    keys = nodes.select("node", F.posexplode("signature").alias("k", "symbol")).select(
        "node", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("symbol").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = staged(keys.join(shared, "key"), "members")
    forget(shared)
    labels = None
    for turn in range(rounds):
        mixed = _labelled(members.select("key", "node"), labels)
        mixed = mixed if labels is None else _still_mixed(mixed)  # at first every shared bucket is mixed
        labels = _grown(labels, _confirmed(texts, nodes, _representatives(mixed, turn)))
    large = staged(members.where(F.col("size") > light).groupBy("node").agg(F.count(F.lit(1)).alias("in_large")), "in-large")
    small = _still_mixed(_labelled(members.where(F.col("size") <= light).select("key", "node"), labels))
    small = small.join(bounded_broadcast(large, MAX_BROADCAST_NODES), "node", "left").withColumn("in_large", F.coalesce("in_large", F.lit(0)))
    labels = _grown(labels, _confirmed(texts, nodes, _across(small)))
    heavy = staged(large.where(F.col("in_large") >= SYMBOLS - DISTANCE).join(nodes.select("node", "signature"), "node"), "heavy")
    forget(members, large)
    if not heavy.isEmpty():
        chunks = [F.xxhash64(F.lit(c), F.lit(out), *[F.get("signature", F.lit(c + j)) for j in range(CHUNK) if j != out]).alias("key")
                  for c in range(0, SYMBOLS, CHUNK) for out in range(CHUNK)]
        spread = staged(heavy.select("node", F.explode(F.array(*chunks)).alias("key")), "wide-keys")  # read twice below
        wide = staged(_still_mixed(_labelled(spread, labels)), "wide")
        labels = _grown(labels, _cluster_links(texts, wide, block))
        forget(spread, wide)
    forget(heavy)
    return labels


def _cluster_links(texts: DataFrame, wide: DataFrame, block: int) -> DataFrame:
    """Links between different components of ``wide(key, node, component)``: nodes that
    meet in a bucket, directly or through others, are compared block by block."""
    first = staged(wide.groupBy("key").agg(F.min("node").alias("b")), "first")
    met = staged(wide.join(first, "key").where("node != b").select(F.col("node").alias("a"), "b").distinct(), "met")
    # a node's least link joins nearly all; only links that are still between components are followed from there
    cluster = _grown(components(met.groupBy("a").agg(F.min("b").alias("b"))), met)
    cluster = staged(cluster.select("node", F.col("component").alias("cluster")).join(wide.select("node", "component").distinct(), "node"), "clusters")
    blocks = cluster.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = cluster.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = dealt.select("cluster", "node", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = staged(paired, "paired").join(texts.withColumnRenamed("row", "node"), "node").select(
        "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "own", "text")

    def compare(table: pa.Table) -> pa.Table:
        node, component, own = (table.column(c).to_numpy() for c in ("node", "component", "own"))
        apart = component[:, None] != component[None, :]
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            apart &= own[:, None] != own[None, :]
        links = []
        if apart.any():
            sets = [shingles(x) for x in table.column("text").cast(pa.binary()).to_pylist()]
            linked = apart & _linked(sets)
            root = list(range(len(node)))
            for a, b in zip(*np.nonzero(np.triu(linked)), strict=True):
                a, b = _root(root, int(a)), _root(root, int(b))
                if a != b:
                    root[b] = a
                    links.append((int(node[a]), int(node[b])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return staged(rows.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long"), "links")


def _root(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = i = root[root[i]]
    return i


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which of a block's sets link, by their exact intersections: an incidence matrix
    times itself, a bounded number of columns at a time."""
    size = np.array([len(x) for x in sets], np.float64)
    of = np.repeat(np.arange(len(sets)), size.astype(int))
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[at] > 1
    of, at = of[keep], shared[at[keep]]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        x, y = np.searchsorted(at, (low, low + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[of[x:y], at[x:y] - low] = 1
        both += part @ part.T
    return 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)


def _judged(docs: DataFrame, sketches: DataFrame, light: int, rounds: int, block: int = BLOCK) -> DataFrame:
    """``row, doc_id, n_shingles, set_key, component, component_id, kept`` of every sketch
    of ``docs(row, doc_id, text)``."""
    filled = sketches.where(F.col("set_key").isNotNull())
    nodes = staged(filled.groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "nodes")
    told = staged(filled.select(F.col("row").alias("node"), "n_shingles", "signature").join(nodes.select("node"), "node"), "signatures")
    labels = staged(link(docs.select("row", "text"), told, light, rounds, block), "components")
    forget(told)
    placed = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = staged(placed.select("set_key", "component").join(least, "component"), "of-set")  # a hot set's join side can be split
    joined = sketches.select("row", "doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    own = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.withColumn("component_id", own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _files(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is a plain read of files, which can be scanned again where
    texts are compared, else a staged copy."""
    return docs if is_plain_read(docs) else staged(docs, "documents")


def near_duplicates(docs: DataFrame, light: int = LIGHT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    docs = _files(docs.select("doc_id", "text"))
    docs = docs.select(row_number(docs).alias("row"), "doc_id", "text")
    sketches = staged(sketch(docs), "sketches")
    return _judged(docs, sketches, light, rounds, block).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, light: int = LIGHT, rounds: int = ROUNDS) -> DataFrame:
    """One document of each group, all its columns: a row of the smallest id (of several,
    the first). Documents without words all stay."""
    docs = _files(docs)
    row = row_number(docs).alias("row")
    slim = docs.select(row, "doc_id", "text")
    sketches = staged(sketch(slim), "sketches")
    judged = staged(_judged(slim, sketches, light, rounds).where("kept").select("row", "component"), "kept")
    one = staged(judged.groupBy(F.coalesce("component", -F.col("row") - 1).alias("group")).agg(F.min("row").alias("row")).select("row"), "one")
    forget(sketches, judged)
    whole = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(row, whole).join(bounded_broadcast(one, MAX_BROADCAST_NODES), "row", "left_semi").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
