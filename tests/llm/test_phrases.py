"""Decontamination and license scan against brute force over every position."""

import hashlib
import random
import re

from tessera.llm import decontaminate as D
from tessera.llm import license_scan as L

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, x in items:
        iw = words(x)
        n = min(10, len(iw))
        for s in range(max(len(iw) - 10, 0) + 1 if iw else 0):
            for at in range(len(w) - n + 1):
                if w[at:at + n] == iw[s:s + n]:
                    hit |= set(range(at, at + n))
                    found.add(item_id)
    return len(w), len(hit), found


PASSAGE = " ".join(f"w{i % 7}x{i % 5}" for i in range(30))
ITEMS = [(1, PASSAGE), (2, "Kurz, aber Über-lang"), (3, None), (4, "..."), (5, PASSAGE), (6, "one"),
         (7, "a b a b a b a b a b a b"), (None, "nameless item text"), (10, PASSAGE.upper())]
DOCS = [(1, f"intro {PASSAGE} outro ONE."), (1, f"intro {PASSAGE} outro ONE."), (2, "kurz aber über lang"), (3, None), (4, ""),
        (None, "nothing. nameless-item text"), (5, " ".join(PASSAGE.split()[3:14])), (6, "a b " * 40), (7, "kurz aber uber lang"),
        (8, PASSAGE.replace("w3x1", "zz")), (9, "x " * 30000 + "one two"), (10, " ".join(PASSAGE.split()[:9]))]


def _frame(spark):
    return spark.createDataFrame([(*d, "x", "y", 0) for d in DOCS], "doc_id long, text string, item_id string, words string, row int")


def test_decontamination_equals_brute_force(spark):
    items = spark.createDataFrame([(*i, "z") for i in ITEMS], "item_id long, text string, doc_id string")
    for block in (D.BLOCK, 2):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                     for r in D.decontaminate(_frame(spark).repartition(3), items, block=block).collect())
        want = []
        for i, x in DOCS:
            n, hit, found = brute_hits(x, ITEMS)
            ids = sorted(str(f) for f in found if f is not None)
            want.append((str(i), n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0))
        assert got == sorted(want)


def test_decontamination_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.decontaminate(_frame(spark).limit(0), items).count() == 0
    rows = D.decontaminate(_frame(spark), items.limit(0)).collect()
    assert len(rows) == len(DOCS) and not any(r.contaminated or r.n_hit or r.n_items for r in rows)


def test_decontamination_on_table(spark, t):
    items = [(r.item_id, r.text) for r in t.benchmark.collect()]
    got = {r.doc_id: r for r in D.decontaminate(t.documents, t.benchmark).collect()}
    index = {}
    for i, x in items:
        iw = words(x)
        n = min(10, len(iw))
        for s in range(max(len(iw) - 10, 0) + 1 if iw else 0):
            index.setdefault(tuple(iw[s:s + n]), set()).add(i)
    for r in t.documents.collect():
        w, hit, found = words(r.text), set(), set()
        for n in {len(k) for k in index}:
            for at in range(len(w) - n + 1):
                if (ids := index.get(tuple(w[at:at + n]))):
                    hit |= set(range(at, at + n))
                    found |= ids
        assert (got[r.doc_id].n_words, got[r.doc_id].n_hit, got[r.doc_id].n_items) == (len(w), len(hit), len(found))


def brute_licenses(text):
    w = words(text)
    places, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    own = set(labels)
    for label, template, keys in L.TEMPLATES:
        tw = words(template)
        back = {k: next(i for i in range(len(tw)) if tw[i:i + len(k.split())] == k.split()) for k in keys}
        first, b = keys[0].split(), back[keys[0]]
        starts = [i - b for i in range(len(w)) if w[i:i + len(first)] == first]
        if any(all(s + b >= 0 and w[s + b:s + b + len(k.split())] == k.split() for k, b in back.items()) for s in starts):
            own.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(own))


LICENSES = ["Licensed under CC BY-NC 4.0.", "All rights reserved. All Rights, reserved! cc by cc by", "GNU General Public License, version 3.",
            "released under the MIT License", "mit license", "general public", "", None, "license " * 20000 + "general public license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "cc", "by cc", "cc0",
            "licensed under the Apache License, Version 2.0", "General public\nlicense all rights reserved cc-by"]


def test_license_scan_equals_brute_force(spark):
    docs = spark.createDataFrame([(i if i != 4 else None, x, "a", "b") for i, x in enumerate(LICENSES)] + [(0, LICENSES[0], "a", "b")],
                                 "doc_id long, text string, words string, label string")
    rows = L.scan(docs.repartition(3)).collect()
    got = sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in rows), key=repr)
    assert got == sorted([brute_licenses(x) for x in [*LICENSES, LICENSES[0]]], key=repr)
    assert all(0 <= r.score <= 1 and (r.score == 1 or not r.base_labels) and (r.score > 0) == bool(r.labels) for r in rows)
    assert L.scan(docs.limit(0)).count() == 0


def test_license_scan_on_table(spark, t):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan(t.documents).collect()}
    for r in t.documents.collect():
        assert got[r.doc_id] == brute_licenses(r.text)[:5]


def test_key_words_that_are_frequent(spark):
    """The key phrases' words are everywhere, in another order; one text holds the phrase."""
    rnd = random.Random(2)
    docs = []
    for label, template, keys in L.TEMPLATES:
        every = [w for k in keys for w in k.split()]
        docs += [" ".join(rnd.sample(every, len(every))) + " filler" * k for k in range(6)]
        docs += [f"before {keys[0]} after", f"some words {template} and more words", template.replace(" ", "  ,", 3)]
        docs += [" ".join(template.split()[:len(template.split()) // 2]), " ".join(reversed(words(template)))]
    for rare in (1, 2, 3, 50):
        rows = L.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3), rare_words=rare).collect()
        assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in rows} == {i: brute_licenses(x) for i, x in enumerate(docs)}


def test_a_whole_licence_scores_higher_than_its_key_phrase(spark):
    label, template, keys = next(t for t in L.TEMPLATES if t[0] == "zlib")
    between = template.split()
    cut = " ".join(between[:len(between) // 2] + ["x"] * 3 + between[len(between) // 2:])
    docs = [(0, template), (1, " gap ".join(keys)), (2, "y " * 400 + template), (3, cut)]
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[0].score == rows[2].score == 1 and rows[2].labels == "zlib" and rows[1].labels == "" and rows[3].labels in ("", "zlib")
