"""Base spans against the plain regular expressions; entities on generated sentences."""

import hashlib
import random
import re
import tracemalloc

import numpy as np

from tessera.llm import pii as P

RULES = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute(text):
    out = []
    for kind, rule in RULES:
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and P.luhn(d)
                    or kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


ODD = ["", "a@b.c", "a@b", "@b.c", "a@@b.c", "x.y@z.w.v@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.0004", "1.2.3", "9" * 400, "4111 1111 1111 1111", "4111-1111-1111-1112",
       "+1 (743) 555-3824", "+1", "++49 30 1234567", "+12", "é@b.co", "a@é.co", "٣.٣.٣.٣", "x@y.z-", "a%b@c-d.e-f+1 2 3 4 5 6 7 8 9", "0000 0000 0000 0000", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "  4111111111111111\n"]


def test_base_spans_equal_the_rules():
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choices("0123456789.@ +-ab()\n", k=rnd.randint(1, 60))) for _ in range(4000)]
    for x in texts:
        assert P.base_spans(x) == brute(x), x


def test_long_runs_are_fast():
    for x in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "a@" * 100_000, "+" * 200_000, "1 " * 100_000):
        P.find(x, np.frombuffer(P.fitted()).reshape(P.FEATURES, -1)) if len(set(x)) > 2 else P.base_spans(x)


def test_find_reads_long_runs_whole_in_bounded_memory():
    w, rnd, last = np.frombuffer(P.fitted()).reshape(P.FEATURES, -1), random.Random(5), "\nssn 123-45-6789\n"
    table = "".join(f"{rnd.randint(0, 10 ** rnd.randint(1, 6))}{rnd.choice(' ,.:|')}" for _ in range(3000))
    for x in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "a@" * 100_000, "+" * 200_000, "1 " * 100_000, table):
        assert ("id", len(x) + 5, len(x) + 16) in P.find(x + last, w)[1], x[:9]
    tracemalloc.start()
    P.find("1." * 5_000, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_best_segmentation_equals_the_whole_lattice():
    w, rnd = np.frombuffer(P.fitted()).reshape(P.FEATURES, -1), random.Random(6)
    for _ in range(40):
        text = " ".join(P._sentence(rnd)[0] for _ in range(2)) + "".join(rnd.choices("0123456789.@ +-ab()\n", k=300))
        for start, end in P.stretches(text):
            lattice = P.Lattice(text, start, end)
            s = lattice.scores(w)
            total, back = [0.0] + [-np.inf] * len(lattice.at), {}
            for k, (i, j) in enumerate(lattice.spans):
                if total[i] + s[k].max() > total[j]:
                    total[j], back[j] = total[i] + s[k].max(), (i, s[k].argmax())
            want, j = [], len(lattice.at)
            while j:
                i, kind = back[j]
                want += [(P.KINDS[kind - 1], lattice.at[i][0], lattice.at[j - 1][1])] if kind else []
                j = i
            assert P.best_entities(text, start, end, w) == want[::-1]


def test_entities_of_unseen_sentences():
    w, rnd, hit, extra, missed = np.frombuffer(P.fitted()).reshape(P.FEATURES, -1), random.Random(77), 0, 0, 0
    for _ in range(300):
        text, gold = P._sentence(rnd)
        found = set(P.find(text, w)[1])
        hit, extra, missed = hit + len(found & set(gold)), extra + len(found - set(gold)), missed + len(set(gold) - found)
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_gradient_is_that_of_the_likelihood():
    text = "mail a.b@c.org or 12"
    lattice = P.Lattice(text, 5, len(text))
    gold = {(0, 7): 1, (7, 8): 0, (8, 9): 0}
    w = np.random.default_rng(1).normal(0, 0.1, (P.FEATURES, 1 + len(P.KINDS)))

    def loglik(w):
        s = lattice.scores(w)
        total = [0.0] + [-np.inf] * len(lattice.at)
        for k, (i, j) in enumerate(lattice.spans):
            total[j] = np.logaddexp(total[j], total[i] + np.logaddexp.reduce(s[k]))
        return sum(s[k, gold[x]] for k, x in enumerate(lattice.spans) if x in gold) - total[-1]

    g = lattice.gradient(w, gold)
    for at in ((0, 0), (1, 1), (4, 3), (13, 0)):
        d = np.zeros_like(w)
        d[at] = 1e-5
        assert abs((loglik(w + d) - loglik(w - d)) / 2e-5 - g[at]) < 1e-4


def test_table_and_odd_rows(spark, t):
    rows = [(-1, None, "x"), (-2, "", "x"), (None, ODD[14], "x"), (-3, ODD[14], "x"), (-3, ODD[14], "x"), (-4, "lorem " * 50_000 + "a@b.co", "x")]
    extra = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    both = t.documents.select("doc_id", "text").union(extra.select("doc_id", "text"))
    got = P.detect(both).collect()
    texts = {}
    for r in both.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len(got) == both.count()
    for r in got:
        want = brute(texts[r.doc_id][0])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, *_ in want) for k in P.BASE_KINDS]
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}
    assert P.detect(extra).where("doc_id = -3").first().redacted == "[PHONE]"
    assert P.detect(extra.limit(0)).count() == 0


def test_redaction_covers_overlaps():
    assert P.redact("ab1234cd", [("ip", 2, 4), ("card", 3, 6)]) == "ab[IP]cd"
    assert P.redact(None, []) is None and P.redact("x", []) == "x"
