"""Conversation repair against a cheapest-path search over whole edit strings."""

import hashlib
import heapq
import random
import zlib

import pytest

from tessera.llm import conversation_repair as R
from tessera.llm.auction import least_paths

SCHEMA = "conv_id long, turn long, role string, text string, kind string, seq int"
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def _damaged(rows):
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else "".join(ch for ch in x if ch not in ".!?") if k == 2 else x
        for _ in range({0: 1, 3: 2}.get(k, 1)):
            yield c, None if k == 0 else (t, "user" if k == 4 else r, x)


def _brute(rows):
    convs, out = {}, {}
    for c, row in _damaged(rows):
        convs.setdefault(c, []).extend([row] if row else [])
    for c, rs in convs.items():
        rs.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
        seen, faults = set(), []
        for _, r, x in rs:
            said = x.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not said else "duplicate" if (r, x) in seen else "truncated" if said[-1] not in ".!?" else None)
            seen.add((r, x))
        turns = {t for t, _, _ in rs if t is not None}
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, q, text = heapq.heappop(heap)
            if i == len(rs) and q in (0, 3):
                break
            if (i, q) in done:
                continue
            done.add((i, q))
            role, to = NEXT[q]
            heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*text, f"{role}:")))
            if i < len(rs):
                _, r, x = rs[i]
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, text))
                if faults[i] in (None, "truncated"):
                    more = 3 if faults[i] else 0
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, (*text, f"{role}:{x}")))
                    if q in KEEP.get(r[:1], {}):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEEP[r[:1]][q], (*text, f"{r}:{x}")))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
                  sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def _rows(seed=5):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "usr"]
    texts = ["Hi.", "Hi", "", "  ", None, "What?", "Yes!\n", "No, not", "a. b", "Ü."]
    rows = []
    for c in [None, *range(40)]:
        for t in range(300 if c == 7 else rnd.choice([1, 2, 3, 5, 8, 30])):
            role = rnd.choice(roles) if rnd.random() < 0.4 else ["user", "assistant"][t % 2]
            rows.append((c, None if rnd.random() < 0.05 else t, role, (rnd.choice(texts) or "") + rnd.choice(["", f"{rnd.randint(0, 40)}."])))
    rows += [(100, 0, None, None), (101, None, "user", "a."), (101, None, "user", "a."), (101, None, "assistant", "b.")]
    gone = next(c for c in range(200, 400) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return [*rows, (gone, 1, "user", "dropped.")], gone


def _compare(spark, rows, **how):
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(4)
    got = R.repair(df, **how).collect()
    assert len({r.conv_id for r in got}) == len(got)
    assert {r.conv_id: tuple(r)[1:] for r in got} == _brute(rows)
    return got


def test_against_search(spark):
    rows, gone = _rows()
    got = _compare(spark, rows)
    assert next(tuple(r)[1:] for r in got if r.conv_id == gone) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("how", [{"max_rows": 0, "slice_rows": 5, "fan": 3}, {"max_rows": 20, "slice_rows": 7, "fan": 100}, {"max_bytes": 100, "slice_rows": 1, "fan": 2}])
def test_slices_agree_with_search(spark, how):
    _compare(spark, _rows(9)[0], **how)


def test_empty_table(spark):
    assert R.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_agrees_with_search(spark):
    from tessera.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, sf).collect()} == _brute(rows)


def _cost(codes, goal):
    """Least (cost, letters) by dynamic programming over all edit strings."""
    best = {(0, 0): (0, "")}
    for i in range(len(codes) + 1):
        for _ in range(3):
            for q in range(4):
                if (i, q) in best and (i < len(codes) or goal is None):
                    c, x = best[i, q]
                    to = (i, NEXT[q][1])
                    best[to] = min(best.get(to, (10**9, "")), (c + 3, x + "I"))
        if i < len(codes):
            for q in range(4):
                if (i, q) in best:
                    c, x = best[i, q]
                    for letter, cost, to in R.ROW_ARCS[codes[i]][q]:
                        best[i + 1, to] = min(best.get((i + 1, to), (10**9, "")), (c + cost, x + letter))
    ends = (0, 3) if goal is None else (goal,)
    return min((best[len(codes), q] for q in ends if (len(codes), q) in best), default=None)


def test_auction_is_least_and_linear():
    rnd = random.Random(1)
    for _ in range(300):
        codes = "".join(rnd.choice("suaoSUAOx") for _ in range(rnd.randint(0, 40)))
        for goal in (None, 0, 1, 2, 3):
            found = least_paths([R.ROW_ARCS[c] for c in codes], goal, (0,)).get(0)
            assert (found and found[:2]) == _cost(codes, goal), codes
    codes = "u" * 20_000
    cost, letters, states = least_paths([R.ROW_ARCS[c] for c in codes], None, (0,))[0]
    assert cost == 30_000 and len(states) == 20_000 and letters.startswith("K")
