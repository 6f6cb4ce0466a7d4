"""Language and quality: held-out accuracy, and defined results for odd rows."""

import zlib

from tessera.llm import langid, quality
from tessera.llm import queries as Q

from ..conftest import SF01


def test_language_held_out_accuracy(spark):
    lang = {r.doc_id: (r.lang, len(r.text)) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = Q.op1_language_id(spark, SF01).collect()
    assert {r.doc_id for r in rows} == set(lang) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id][1] >= 30]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) >= 0.98 * len(held)


def test_language_odd_rows(spark):
    rows = [(1, "the house and the dog", "en", "a"), (2, "der hund und das haus", "de", "a"), (3, None, "en", "a"), (4, "... 123 !!", "de", "a"),
            (5, "le chien et la maison", "fr", "a"), (None, "the end", "en", "a"), (6, "no language", None, "a"), (1, "the house and the dog", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[3] == by[4] == "und" and by[2] == "de" and by[5] == "fr" and by[6] in {"de", "en", "fr"}
    empty = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.predict(model, "x" * 300_000)[0] in {"de", "en", "fr"}


def test_hierarchy_votes_inside_the_family_only():
    texts = {"en": "the and of with this", "de": "der und die mit nicht", "nl": "het een van niet zijn", "fr": "le et la avec pour", "es": "el los con para que", "xx": "qq zz kk"}
    import numpy as np
    model = langid.fit(np.array([langid.profile(v) for v in texts.values()] * 3), list(texts) * 3)
    assert set(model["pairs"]) == {("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")} and model["members"]["other"] == ["xx"]
    assert all(langid.predict(model, v)[0] == k for k, v in texts.items())


def test_quality_held_out_accuracy(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = Q.op2_quality(spark, SF01).collect()
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.97 * len(held)


def test_quality_odd_rows(spark):
    good, bad = "Plain words make a sentence, and another one follows it here.", "BUY!! NOW!! BUY!! NOW!! BUY!! NOW!!"
    rows = [(i, good if i % 2 else bad, "q") for i in range(40)] + [(50, None, "q"), (51, "", "q"), (None, good, "q"), (52, good * 9000, "q"), (1, good, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (50, None), (3, 1)], "doc_id long, quality int")
    got = {}
    model = quality.train(docs, labels)
    for r in quality.classify(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r.predicted)
    assert got[0] == [0] and got[1] == [1, 1] and got[52] == [1] and got[None] == [1] and got[50] == got[51]
    assert quality.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality.classify(docs, None).collect()} == {1.0}
    assert quality.classify(docs.limit(0), model).count() == 0


def test_attention_weights_find_the_bad_passage():
    import numpy as np
    good, bad = b"Plain words make a sentence, and another one follows it here. ", b"BUY!! NOW!! FREE!! CASH!! HERE!! BUY!! NOW!! "
    bags = [quality.passages(good * 60 + (bad * 8 if i % 2 else b"") + good * 60) for i in range(60)]
    model = quality.fit(bags, np.array([float(i % 2 == 0) for i in range(60)]))
    assert (quality.score(model, [good * 80 + bad * 8 + good * 50]) < 0.3).all() and (quality.score(model, [good * 130]) > 0.7).all()
