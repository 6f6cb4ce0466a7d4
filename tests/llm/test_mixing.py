"""Mixing against a sequential model of the same draws, and its guarantees."""

import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size int, sid string"


def _hash(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(struct.pack("<q", p), h)
    return h - (1 << 64) if h >> 63 else h


def _permuted(x, n, *keys, inverse=False):
    for r in reversed(range(M.ROUNDS)) if inverse else range(M.ROUNDS):
        other = (_hash(*keys, r) - x) % n
        if _hash(*keys, r, max(x, other)) & 1:
            x = other
    return x


def _targets(sizes):
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_ for s in names}
        above = {s for s in names if s not in capped and share[s] > 3 * sizes[s]}
        if not above:
            return names, share
        capped |= above


def _model(docs, block, shard):
    """``taken`` of each document (by place), drawing slot after slot."""
    sizes = [len((t or "").encode().split()) for _, t, _ in docs]
    per = defaultdict(int)
    for (_, _, s), n in zip(docs, sizes, strict=True):
        per[s] += n
    names, target = _targets(per)
    order = defaultdict(list)
    for k, (i, _, s) in enumerate(docs):
        own = 42 if i is None else xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
        own -= (own >> 63) << 64
        order[s].append((_hash(M.SEED, own), (i is not None, i or 0), sizes[k], k))
    draws, streams = {}, {}
    for sid, s in enumerate(names):
        stream = streams[s] = [k for *_, n, k in sorted(order[s]) for _ in range(n)]
        blocks = [stream[b:b + block] for b in range(0, len(stream), block)]
        left, draws[sid], j = round(target[s]), [], 0
        while left > 0:
            got = blocks[_permuted(j % len(blocks), len(blocks), M.SEED, sid, j // len(blocks))][:left]
            draws[sid].append(got)
            left -= len(got)
            j += 1
    return sizes, [target[s] for _, _, s in docs], [per[s] for _, _, s in docs], Counter(k for x in draws.values() for got in x for k in got), {sid: len(x) for sid, x in draws.items()}


def _docs():
    docs = [(i, " ".join(f"w{j}" for j in range((i * 37) % 90)), ["a", "b", "Z", None, "é", "tiny"][min(i % 7, 5) if i % 11 else 5 if i == 0 else 3]) for i in range(150)]
    docs += [(3, "again a row", "a"), (3, "again a row", "a"), (None, "no id here", "b"), (None, None, "b"), (500, "", "empty"), (501, " \t\n ", "empty"), (502, "one", "tiny")]
    return docs


@pytest.mark.parametrize(("block", "shard"), [(16, 8), (256, 1024), (1, 50)])
def test_against_a_sequential_model(spark, block, shard):
    docs = _docs()
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], SCHEMA).repartition(3)
    m = M.mix(df, block_words=block, shard_blocks=shard)
    rows = M.taken(m).collect()
    sizes, target, source, taken, quota = _model(docs, block, shard)
    want = Counter((d[0], sizes[k], source[k], round(target[k], 6), taken[k]) for k, d in enumerate(docs))
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in rows) == want
    # every slot of every shard is filled once, every source as often as it needs
    draws = m.draws.collect()
    assert Counter(r.sid for r in draws) == Counter({k: v for k, v in quota.items() if v})
    slots = Counter((r.shard, r.slot) for r in draws)
    total = sum(quota.values())
    assert set(slots) == {(k // shard, k % shard) for k in range(total)} and max(slots.values()) == 1


def test_shards_follow_their_multinomial_draw(spark):
    """A shard's counts are its slots' draws, but for the surplus that was dealt on."""
    df = spark.createDataFrame([(i, "w " * 200, f"s{i % 4}", 0, "") for i in range(80)], SCHEMA)
    m = M.mix(df, block_words=10, shard_blocks=100)
    quota = {r.sid: r.quota for r in m.sources.collect()}
    total, edges = sum(quota.values()), []
    for sid in sorted(quota):
        edges += [sid] * quota[sid]
    drawn = Counter((k // 100, edges[_hash(M.SEED, k) % total]) for k in range(total))
    got = Counter((r.shard, r.sid) for r in m.draws.collect())
    sums = Counter()
    for (_, sid), n in drawn.items():
        sums[sid] += n
    surplus = sum(max(0, sums[s] - quota[s]) for s in quota)
    assert sum((drawn - got).values()) == sum((got - drawn).values()) <= surplus < total // 10


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame([(*d, 5, "x") for d in _docs()], SCHEMA)
    runs = [Counter(map(tuple, M.taken(M.mix(df.repartition(n), block_words=8, shard_blocks=16)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.taken(M.mix(df)).count() == 0
    df = spark.createDataFrame([(1, None, "a", 0, ""), (2, " ", None, 0, "")], SCHEMA)
    assert sorted(map(tuple, M.taken(M.mix(df)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_permutations_are_inverted(spark):
    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(M.permuted(F.col("id"), F.lit(n), 7, 3).alias("y"), F.col("id")).withColumn("x", M.permuted(F.col("y"), F.lit(n), 7, 3, inverse=True)).collect()
        assert sorted(r.y for r in got) == list(range(n)) and all(r.x == r.id and r.y == _permuted(r.id, n, 7, 3) for r in got)


def test_word_counts(spark):
    texts = ["", " ", "a", " a  b ", "a\tb\nc\x0bd\x0ce\rf", "x\x1cy z", "ü　v w", "word " * 999, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", M.words_in(F.col("t")).alias("n")).collect()
    assert all(r.n == len((texts[r.i] or "").encode().split()) for r in rows)


def test_texts_of_the_mix(spark):
    docs = [(i, f" first{i}  " + "\n".join(f"d{i}w{j}" for j in range(i * 5)) + " ", "ab"[i % 2]) for i in range(20)]
    df = spark.createDataFrame([(*d, 0, "") for d in docs], SCHEMA)
    m = M.mix(df, block_words=12, shard_blocks=4)
    words = {i: t.split() for i, t, _ in docs}
    rows = M.mixed_texts(m, df).collect()
    assert all(r.text.split(" ") == words[r.doc_id][r.first_word:r.first_word + r.n_words] for r in rows)
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r.n_words
    assert {r.doc_id: r.taken for r in M.taken(m).collect() if r.taken} == dict(taken)
