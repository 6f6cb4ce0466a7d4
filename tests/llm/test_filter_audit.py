"""Filter audit against applying every order to every document."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, part string, mask int"


def _fails(i, text, least):
    text = text or ""
    words = text.encode().split()
    points = len(text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * points,
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and least is not None and i > least}


def _brute(docs, labels):
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    rows, out = [(lang or "", i, _fails(i, text, least.get(text or ""))) for i, text, lang, *_ in docs], {}
    for part in {p for p, *_ in rows}:
        mine = [(i, f) for p, i, f in rows if p == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                go = [(i, f) for i, f in left if f[x]]
                left = [(i, f) for i, f in left if not f[x]]
                removed[x] += len(go)
                fails = [f for _, f in mine if f[x]]
                out[part, "".join(order), step] = [len(left), len(go), len(fails) - len(go), sum(sum(f.values()) == 1 for f in fails),
                                                   sum(i in good for i, _ in go), sum(i in toxic for i, _ in go)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def _audit(spark, docs, labels):
    df = spark.createDataFrame([(*d, "p", 7) for d in docs], DOCS).repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = A.filter_audit(df, told).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_against_every_order(spark):
    long = " ".join(f"w{i}" for i in range(120))
    texts = ["", None, "few words", "SHOUTING WORDS", long, long + " $", "a b " * 200, "A " * 150, long, "x # y", "ÄÖ é", " \x1c ", "few words"]
    docs = [(i, texts[i % len(texts)], ["en", "de", None, ""][i % 4]) for i in range(60)]
    docs += [(0, "", "en"), (None, "few words", "en"), (None, None, None), (2, "few words", "de"), (3, "a | b", "de")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None), (999, 1, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    assert _audit(spark, docs, labels) == _brute(docs, labels)


def test_repeated_smallest_id_is_no_copy(spark):
    docs = [(1, "same", "en"), (1, "same", "en"), (1, "same", "de"), (2, "same", "de"), (None, "same", "en")]
    got = _audit(spark, docs, [(1, 1, 0)])
    assert got == _brute(docs, [(1, 1, 0)])
    assert got["en", "EABCD", 1][1] == 0 and got["de", "EABCD", 1][1] == 1


def test_empty_tables(spark):
    assert _audit(spark, [], [(1, 1, 1)]) == {}
    docs = [(1, "a", "en")]
    assert _audit(spark, docs, []) == _brute(docs, [])


def test_long_texts_are_counted_in_stretches(monkeypatch):
    text = (" \n".join(f"w{i % 700}" for i in range(5_000)) + " \t").encode()
    whole = A.word_counts(text)
    monkeypatch.setattr(A, "STRETCH", 1000)
    assert A.word_counts(text) == whole == (5_000, 700)
    assert A.word_counts(b"x" * 5_000) == (1, 1) and A.word_counts(b"") == (0, 0)


def test_path_counts():
    forward, backward = A.path_counts(5)
    assert forward[-1] == backward[0] == 120
    for s in range(32):
        for f in range(5):
            if not s >> f & 1:
                through = sum(set(o[:bin(s).count("1")]) == {g for g in range(5) if s >> g & 1} and o[bin(s).count("1")] == f for o in permutations(range(5)))
                assert forward[s] * backward[s | 1 << f] == through


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 0, 0), ("p", 3, 2, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in A.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (5, 5, 0, 3, 1, 1, 8), ("XY", 2): (5, 0, 2, 0, 0, 0, 2), ("YX", 1): (8, 2, 0, 0, 1, 1, 2), ("YX", 2): (5, 3, 2, 3, 0, 0, 8)}
    with pytest.raises(ValueError):
        A.audit(cells, "ABCDEFGHI")


def test_query_agrees_with_brute_force(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op13_filter_audit"](spark, sf).collect()
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", F.col("toxic")).collect()]
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows} == _brute(docs, labels)
