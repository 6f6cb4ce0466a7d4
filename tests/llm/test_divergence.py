"""Base counts against a plain version; verdicts on labelled rows."""

import re

import numpy as np

from tessera.llm import divergence as V

from ..conftest import SF01


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


ODD = ["", "a", "a b", "a b c a b c", "x\nx\n x\n\nx", "é€😀 é€😀 é€😀 é€😀", "\x1c a\xa0b c", "# * | <>", "a b c d a b c\r\na b c d", " \t\n"]


def test_counts_equal_brute_force():
    for x in ODD:
        assert V.measure(x.encode())[:5] == brute(x), x
    assert V.measure(None)[:5] == (0, 0, 0, 0, 0)


def test_distance():
    p, q = np.array([1, 1, 0]), np.array([0, 0, 3])
    assert V.distance(p, q)[0] == 1 and V.distance(p, 7 * p)[0] == 0 and V.distance(0 * p, q)[0] == 0
    assert abs(V.distance(np.array([1, 0]), np.array([1, 1]))[0] - 0.5579230452841438) < 1e-12


def test_verdicts_on_labelled_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = V.quality_rules(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(text)
    for r in rows[:150]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text[r.doc_id])
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    judged = [r for r in rows if not r.base_failed and r.doc_id in label]
    good, bad = [r for r in judged if label[r.doc_id]], [r for r in judged if not label[r.doc_id]]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.85 * len(bad)


def test_odd_rows(spark):
    rows = [(i, x, "en") for i, x in enumerate(ODD)] + [(None, None, None), (1, "word " * 100_000, "en"), (2, "the " + " ".join(map(str, range(80))), None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, chars int")
    got = V.quality_rules(df).collect()
    assert len(got) == len(rows) and [r.kept for r in got if r.doc_id is None] == [False]
    assert V.quality_rules(df.limit(0)).count() == 0


def test_a_text_in_two_languages_is_no_outlier(spark):
    import random
    rnd = random.Random(1)

    def prose(lang, n):
        return " ".join(rnd.choice(V.COMMON[lang].split()) if rnd.random() < 0.4 else "".join(rnd.choices("abcdefgh", k=5)) for _ in range(n))

    rows = [(i, prose(lang, 200), lang) for i, lang in enumerate(["en", "fr"] * 30)]
    rows += [(100, prose("en", 150) + " " + prose("fr", 150), "en"), (101, " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(300)), "en")]
    got = {r.doc_id: r for r in V.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100].kept and not got[101].kept and all(got[i].kept and got[i].nearest == rows[i][2] for i in range(60))


def test_rare_and_unlisted_languages_do_not_switch_the_word_rule_off(spark):
    import random
    rnd = random.Random(2)
    common = {"en": V.COMMON["en"].split(), "fi": "ja on ei se oli että hän joka mutta kun niin kuin ovat myös".split()}

    def word():
        return "".join(rnd.choices("abcdefgh", k=rnd.randint(4, 7)))

    def prose(lang, n):
        return " ".join(rnd.choice(common[lang]) if lang in common and rnd.random() < 0.4 else word() for _ in range(n))

    rows = [(i, prose("en", 300), "en") for i in range(40)] + [(100 + i, prose("fi", 300), "fi") for i in range(20)]
    rows += [(200 + i, prose("tr", 300), "tr") for i in range(3)] + [(300 + i, " ".join("".join(rnd.choices("的一是不了人我在有他", k=12)) for _ in range(60)), "zh") for i in range(12)]
    junk = [(400, prose("", 600), "en"), (401, prose("", 600), "fi"), (402, prose("", 600), None)]
    got = {r.doc_id: r for r in V.quality_rules(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")).collect()}
    assert not any(got[i].kept for i, *_ in junk)
    assert all(got[i].kept and got[i].nearest == lang for i, _, lang in rows)
    assert all((got[i].word_distance == 0) == (lang in ("tr", "zh")) for i, _, lang in rows)
