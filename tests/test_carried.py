"""Bounded notes over slices, and matching-blocks similarity, against plain versions."""

import difflib
import random

from tessera.operators import blocks as B
from tessera.operators.carried import bounded_notes

NOTES = "run_id string, slot string, seq int, note string"


def in_order(rows, cap):
    """The rule note by note, in memory."""
    slots = {}
    for run, slot, _, note in sorted(rows, key=lambda r: (r[0] or "", r[1] or "", r[2], r[3] or "")):
        held = slots.setdefault((run, slot), [])
        if note and note not in held:
            slots[run, slot] = (held + [note])[-cap:]
    return {(run, slot, i + 1, note) for (run, slot), held in slots.items() for i, note in enumerate(held)}


def test_one_hot_slot_over_many_slices(spark):
    draw = random.Random(5)
    hot = [("r", "hot", i, f"n{draw.randrange(14)}") for i in range(4000)]
    # notes in turn, one more than a slot holds: runs from different beginnings stay apart for long
    turn = [("r", "turn", i, f"n{i % 9}" if i % 500 else "n0") for i in range(4000)]
    few = [(f"r{i % 40}", "s", i, f"n{draw.randrange(5)}") for i in range(1000)]
    odd = [(None, "s", 1, "a"), (None, "s", 2, "b"), ("r", None, 1, "c"), ("r", "none", 1, None), ("r", "none", 2, ""), ("r", "tie", 1, "y"), ("r", "tie", 1, "x")]
    rows = hot + turn + few + odd
    shown = []
    got = bounded_notes(spark.createDataFrame(rows, NOTES), 8, n_slices=12, seen=lambda p: shown.append(p.collect()))
    assert {tuple(r) for r in got.collect()} == in_order(rows, 8)
    pieces = [p for p in shown[0] if p.slot == "hot"]
    assert len(pieces) >= 4 and max(p.n_read for p in pieces) < 2000  # the hot slot is spread over tasks
    again = sum(p.n_read for p in shown[1] if p.slot == "hot")
    assert 0 < again < 2000  # run again only until the runs agree
    assert len(shown) <= 13


def test_notes_of_an_empty_table_and_other_columns(spark):
    assert bounded_notes(spark.createDataFrame([], NOTES)).count() == 0
    more = spark.createDataFrame([("r", "s", 1, "a", 7)], NOTES + ", piece int")
    assert [tuple(r) for r in bounded_notes(more, 2).collect()] == [("r", "s", 1, "a")]


WORDS = ["Brand 11", "Brand#11", "brand#12", "BRAND", "", "a", "tide of the north", "the north tide", "north of the tide", "naïve café",
         "cafe naive", "aaaaabaaaa", "aaaabaaaaa", "🙂🙃🙂", "🙂🙂", "abcabcabc", "cbacbacba", "urgent", "1-URGENT", "5-LOW", "low"]


def test_ratio_is_that_of_matching_blocks():
    draw = random.Random(3)
    texts = WORDS + ["".join(draw.choice("abcd ") for _ in range(draw.randrange(30))) for _ in range(40)]
    for v in texts:
        for x in texts:
            assert B.ratio(v, x) == difflib.SequenceMatcher(None, v, x).ratio(), (v, x)


def test_closest_by_blocks(spark):
    column = ("t", "c")
    stored = spark.createDataFrame([(*column, w) for w in WORDS] + [("t", "other", "urgent"), (*column, None)], "table_name string, column_name string, value string")
    asked = [(w, *column, w) for w in ("brand 11", "urgent", "the tide", "🙂", "zzz", "abc")] + [("null", *column, None), ("nowhere", "t", "x", "urgent")]
    needles = spark.createDataFrame(asked, "needle_id string, table_name string, column_name string, literal string")
    shown = []
    got = B.closest_by_blocks(needles, stored, 5, 0.4, seen=lambda p: shown.append(p.count())).collect()
    for needle, *_ in asked[:6]:
        close = difflib.get_close_matches(needle, WORDS, n=5, cutoff=0.4)
        rest = sorted((w for w in WORDS if w not in close), key=lambda w: w.encode())
        mine = sorted((r for r in got if r.needle_id == needle), key=lambda r: r["rank"])
        assert [r.value for r in mine] == (close + rest)[:5], needle
        assert [r.close for r in mine] == [i < len(close) for i in range(5)]
    assert not any(r.needle_id in ("null", "nowhere") for r in got)
    assert shown[0] < 6 * len(WORDS) / 2  # the bound leaves less than half of the pairs
