"""Near-duplicates against brute force over all pairs of full shingle sets."""

import random
import re

from tessera.llm import neardup as N


def brute(docs):
    sets = []
    for _, x in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((repr(d), len(s), least.get(find(i)) if s else d, d == (least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def got(df, **k):
    return sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, **k).collect())


def corpus(seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choices("abcdefgh", k=4)) for _ in range(400)]

    def text(n):
        return [rnd.choice(vocab) for _ in range(n)]

    docs = []
    passage = text(60)
    for _ in range(60):  # a passage that many share, in long and short texts
        docs.append(text(rnd.choice([0, 5, 15, 40, 150])) + passage + text(rnd.choice([0, 3, 10, 150])))
    base = text(200)
    for _ in range(60):  # a large group of near copies, a word or two changed each
        x = list(base)
        for _ in range(rnd.choice([1, 1, 2, 4, 8, 12])):
            x[rnd.randrange(len(x))] = rnd.choice(vocab)
        docs.append(x)
    for _ in range(40):  # chains: each near the one before
        docs.append(list(docs[-1][3:]) + text(3))
    docs += [text(rnd.choice([1, 3, 4, 5, 6, 50, 300])) for _ in range(60)]
    out = [(i * 3 % 241 + 1000, " ".join(x)) for i, x in enumerate(docs)]
    out += [(5, ""), (6, None), (7, " \n\t"), (8, "one Two three"), (9, "ONE two\nthree"), (10, "one two"), (None, "one two three"),
            (None, "lonely words without any id at all"), (1, out[70][1].upper()), (1000, out[0][1]), (1000, out[0][1]), (11, "É é a b c d"), (12, "é É a b c d")]
    return out


def test_equals_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, node string, row int").repartition(4)
    assert got(df) == brute(docs)


def test_heavy_path_equals_brute_force(spark):
    """With light buckets of two nodes, most of the work goes through chunks of four
    symbols, and with blocks of eight nodes through pairs of blocks."""
    docs = corpus(9)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(df, light=2, rounds=1, block=8) == brute(docs)


def test_empty_table_and_no_links(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "")], "doc_id long, text string")
    assert got(df) == brute([(1, "a b c d e f"), (2, "g h i j k l"), (3, "")])
    assert got(df.limit(0)) == []


def test_table_equals_brute_force(spark, t):
    assert got(t.documents) == brute([(r.doc_id, r.text) for r in t.documents.collect()])


def test_every_pair_within_the_distance_is_enumerated():
    """A pair of signatures at distance DISTANCE always shares a key of either index."""
    rnd = random.Random(1)
    for _ in range(200):
        wrong = set(rnd.sample(range(N.SYMBOLS), N.DISTANCE))
        assert any(len(wrong & set(range(c, c + N.CHUNK))) <= 1 for c in range(0, N.SYMBOLS, N.CHUNK))
        assert N.SYMBOLS - len(wrong) > N.SYMBOLS - N.DISTANCE - 1


def test_clusters_follow_one_link_of_a_node_first(spark, monkeypatch):
    """Before, every label round joined all links of all wide buckets."""
    rnd, seen, whole = random.Random(3), [], N.components
    monkeypatch.setattr(N, "components", lambda links: seen.append((links.count(), links.select("a").distinct().count())) or whole(links))
    wide = spark.createDataFrame([(k, n, n) for n in range(40) for k in rnd.sample(range(12), 6)], "key long, node long, component long")
    texts = spark.createDataFrame([(n, "one two three four five six") for n in range(40)], "row long, text string")
    links = N._cluster_links(texts, wide, 8)
    assert seen[0][0] == seen[0][1] < 40
    assert {(r.node, r.component) for r in whole(links).collect()} == {(n, 0) for n in range(40)}
