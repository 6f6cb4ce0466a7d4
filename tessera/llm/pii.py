"""Personal data by fixed patterns plus a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are found exactly as their regular
expressions define them and always stay. Around every stretch of tokens with a digit
or an at sign, a semi-Markov CRF scores whole candidate segments of up to
``MAX_PIECES`` pieces: shape, check sums, length and randomness of the span, the words
before it and its boundaries are features of the segment, not of single tokens. The
best segmentation chooses boundaries and types jointly by dynamic programming, which
reads a stretch of any length piece by piece; its entities that overlap no base span are added (types ``id`` and ``secret``, and
spellings of the base types that their patterns miss).

The CRF is fitted here by conditional likelihood (forward-backward over segments) on
generated sentences with a fixed seed; it sees no corpus.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by
one; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import extended

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "secret")
MAX_PIECES = 16
STARTS = 64  # pieces whose candidate segments are scored at a time

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit run is tried from its first digit only: a later start fails or succeeds alike.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TRIGGER = re.compile(r"[0-9@]\S*")
_PIECE = re.compile(r"[^\W_]+|[^\s]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches ``(kind, start, end)`` by kind, then start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _SIGN.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x[-3:]) <= 255 for x in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# Words that announce each type.
CUES = (("email", re.compile(r"mail|e-mail|contact|correo|courriel")), ("ip", re.compile(r"\bip\b|host|server|addr")),
        ("card", re.compile(r"card|visa|master|amex|karte|tarjeta|carte|credit")), ("phone", re.compile(r"phone|\btel|call|mobile|fax|handy|móvil|fon\b")),
        ("id", re.compile(r"\bssn\b|social sec|iban|passport|tax|steuer|\bdni\b|\bnif\b|insurance")),
        ("secret", re.compile(r"token|secret|passw|api[_ -]?key|\bkey\b|bearer|credential|auth")),
        ("number", re.compile(r"version|page|chapter|order|room|section|year|isbn|item|since|no\.")))
_SHAPES = (
    ("email", re.compile(r"[^\s@]+@[\w-]+(\.[\w-]+)+")), ("at", re.compile(r".*@.*", re.S)), ("ip", re.compile(r"\d{1,3}(\.\d{1,3}){3}")),
    ("card", re.compile(r"\d(?:[ -]?\d){12,18}")), ("plus", re.compile(r"\+\d[ ().\d-]{6,18}\d")), ("phone", re.compile(r"\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4}")),
    ("short phone", re.compile(r"\d{3}[ .-]\d{4}")), ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}")), ("iban", re.compile(r"[A-Z]{2}\d{2}( ?[A-Z0-9]){11,30}")),
    ("hex", re.compile(r"[0-9a-fA-F]{24,}")), ("mixed", re.compile(r"(?=\S*\d)(?=\S*[A-Za-z])[A-Za-z0-9_+/=-]{16,}")), ("prefixed", re.compile(r"(AKIA|ghp_|gho_|sk[-_]|pk_|xox[abp]-|AIza)[\w-]{10,}")),
    ("number", re.compile(r"\d+([.,:/]\d+)*")), ("date", re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}")), ("short", re.compile(r".{1,6}", re.S)), ("word", re.compile(r"[^\W\d_]+")),
    ("mark", re.compile(r"[^\w\s]+")))
FEATURES = 1 + len(_SHAPES) + len(CUES) + 8


def _iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _form(s: str) -> tuple[float, ...]:
    """Features of a segment's own characters."""
    shapes = [1.0 if p.fullmatch(s) else 0.0 for _, p in _SHAPES]
    more = (bool(shapes[3]) and luhn(_digits(s)), bool(shapes[8]) and s.isascii() and _iban(s), bool(shapes[2]) and all(int(x) < 256 for x in s.split(".")),
            s[0].isalnum() != s[-1].isalnum(), " " in s or "\n" in s, "\n" in s, len(s) > 1 and not s[-1].isalnum())
    return (*shapes, *(1.0 if x else 0.0 for x in more))


_known_form = lru_cache(maxsize=1 << 14)(_form)


def _features(text: str, a: int, b: int, cues: list[float]) -> list[float]:
    form = _known_form(text[a:b]) if b - a <= 64 else _form(text[a:b])
    n = len(_SHAPES)
    edge = 1.0 if text[a - 1:a].isalnum() or text[b:b + 1].isalnum() else 0.0
    return [1.0, *form[:n], *cues, *form[n:n + 3], edge, *form[n + 3:]]


def _candidates(text: str, a: int, ends) -> list[list[float]]:
    """Feature vectors of the segments that start at ``a``, one for each end."""
    near = text[max(0, a - 32):a].lower()[-32:]
    cues = [1.0 if p.search(near) else 0.0 for _, p in CUES]
    return [_features(text, a, b, cues) for b in ends]


def best_entities(text: str, start: int, end: int, w: np.ndarray) -> list[tuple[str, int, int]]:
    """Entities of the best segmentation of one stretch of text of any length: features
    of ``STARTS`` pieces at a time, and a few numbers for each piece."""
    begin, stop = array("q"), array("q")
    for m in _PIECE.finditer(text, start, end):
        begin.append(m.start())
        stop.append(m.end())
    n = len(begin)
    total, length, kind = array("d", [-math.inf]) * (n + 1), bytearray(n + 1), bytearray(n + 1)
    total[0] = 0.0
    for first in range(0, n, STARTS):
        rows, spans = [], []
        for i in range(first, min(first + STARTS, n)):
            ends = stop[i:i + MAX_PIECES]
            rows += _candidates(text, begin[i], ends)
            spans += [(i, i + k) for k in range(1, len(ends) + 1)]
        s = np.array(rows) @ w
        s[[j - i > 1 for i, j in spans], 0] = -1e9
        for (i, j), c, value in zip(spans, s.argmax(axis=1).tolist(), s.max(axis=1).tolist()):  # by start, so total[i] is final
            if total[i] + value > total[j]:
                total[j], length[j], kind[j] = total[i] + value, j - i, c
    out, j = [], n
    while j:
        if kind[j]:
            out.append((KINDS[kind[j] - 1], begin[j - length[j]], stop[j - 1]))
        j -= length[j]
    return out[::-1]


class Lattice:
    """Candidate segments of one short stretch of text (a training sentence) and their feature vectors."""

    def __init__(self, text: str, start: int, end: int):
        self.at = [m.span() for m in _PIECE.finditer(text, start, end)]
        self.spans, rows = [], []
        for i, (a, _) in enumerate(self.at):
            ends = [b for _, b in self.at[i:i + MAX_PIECES]]
            rows += _candidates(text, a, ends)
            self.spans += [(i, i + k) for k in range(1, len(ends) + 1)]
        self.x = np.array(rows).reshape(-1, FEATURES)
        self.single = np.array([j - i == 1 for i, j in self.spans], bool)

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Segment scores by type; only single pieces may be outside any entity (type 0)."""
        s = self.x @ w
        s[~self.single, 0] = -1e9
        return s

    def gradient(self, w: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """Of the log likelihood of ``gold``: observed minus expected features."""
        s, n = self.scores(w), len(self.at)
        top = s.max(axis=1)
        each = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        ahead, after = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = after[n] = 0.0
        for k, (i, j) in enumerate(self.spans):
            ahead[j] = np.logaddexp(ahead[j], ahead[i] + each[k])
        for k in range(len(self.spans) - 1, -1, -1):
            i, j = self.spans[k]
            after[i] = np.logaddexp(after[i], after[j] + each[k])
        i, j = np.array(self.spans).T
        p = np.exp(np.minimum(s + (ahead[i] + after[j] - ahead[n])[:, None], 0.0))
        seen = np.zeros_like(p)
        for k, span in enumerate(self.spans):
            if span in gold:
                seen[k, gold[span]] = 1.0
        return self.x.T @ (seen - p)


def _sentence(rnd: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated sentence and its entities."""
    def number(n):
        return "".join(rnd.choice("0123456789") for _ in range(n))

    def word():
        return "".join(rnd.choices("abdeghilmnoprstuv", k=rnd.randint(2, 9)))

    def card():
        d = number(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return rnd.choice((d, " ".join(d[i:i + 4] for i in range(0, 16, 4)), "-".join(d[i:i + 4] for i in range(0, 16, 4))))

    def iban():
        body = number(18)
        check = 98 - int(body + "131400") % 97
        s = f"DE{check:02d}{body}"
        return rnd.choice((s, " ".join(s[i:i + 4] for i in range(0, len(s), 4))))

    def secret():
        k = rnd.random()
        if k < 0.5:
            return "".join(rnd.choices("0123456789abcdef", k=rnd.choice((32, 40, 64)))).translate(str.maketrans("", "") if k < 0.4 else {i: chr(i).upper() for i in range(97, 103)})
        alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
        return rnd.choice(("AKIA", "ghp_", "sk-", "")) + "".join(rnd.choices(alnum, k=rnd.randint(20, 40)))

    made = {
        "email": lambda: f"{word()}{rnd.choice(('.', '', '_'))}{number(rnd.randint(0, 2))}{word()}@{word()}.{rnd.choice(('com', 'org', 'example.net'))}",
        "ip": lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)), "card": card,
        "phone": lambda: rnd.choice((f"+{number(2)} ({number(3)}) {number(3)}-{number(4)}", f"+{number(11)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}")),
        "id": lambda: rnd.choice((f"{number(3)}-{number(2)}-{number(4)}", iban())), "secret": secret,
    }
    cue = {"email": "mail", "ip": "host", "card": "card", "phone": "phone", "id": "ssn", "secret": "token ="}
    plain = (lambda: number(rnd.randint(1, 6)), lambda: f"version {number(1)}.{number(1)}", lambda: f"{number(1)}.{number(1)}.{number(1)}", lambda: f"20{number(2)}-0{rnd.randint(1, 9)}-1{number(1)}",
             lambda: f"{number(2)}:{number(2)}", lambda: f"{number(1)},{number(3)}", lambda: f"order {number(rnd.randint(7, 12))}", lambda: f"{word()}{number(2)}", lambda: f"{number(3)}. {word()}",
             lambda: f"${number(3)}.{number(2)}", lambda: f"page {number(3)}", lambda: f"@{word()}", lambda: f"{word()} @ {word()}", lambda: f"{number(4)}-{number(4)}", lambda: f"{number(2)}%%%")
    text, spans = "", []
    for _ in range(rnd.randint(1, 3)):
        text += " ".join(word() for _ in range(rnd.randint(1, 4))) + rnd.choice((" ", ". ", "\n"))
        if rnd.random() < 0.55:
            kind = rnd.choice(KINDS)
            text += rnd.choice(("", cue[kind] + " ")) + (quote := rnd.choice(("", "", '"')))
            start = len(text)
            text += made[kind]()
            spans.append((kind, start, len(text)))
            text += quote + rnd.choice((" ", ", ", ". ", "!! ", "### "))
        else:
            text += rnd.choice(plain)() + " "
    return text, spans


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of white-space separated tokens that hold a digit or an at sign."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        start, least = m.start(), out[-1][1] if out else 0
        while start > least and not text[start - 1].isspace():
            start -= 1
        if out and text[out[-1][1]:start].isspace():
            out[-1] = (out[-1][0], m.end())
        else:
            out.append((start, m.end()))
    return out


@lru_cache(maxsize=4)
def fitted(sentences: int = 300, rounds: int = 6, seed: int = 11) -> bytes:
    """Weights of the CRF, ``FEATURES`` x (1 + types), by AdaGrad on the likelihood."""
    rnd = random.Random(seed)
    cases = []
    for _ in range(sentences):
        text, spans = _sentence(rnd)
        for a, b in stretches(text):
            lattice = Lattice(text, a, b)
            gold, covered = {}, set()
            for kind, s, e in spans:
                inside = [k for k, (x, y) in enumerate(lattice.at) if s <= x and y <= e]
                if inside and lattice.at[inside[0]][0] == s and lattice.at[inside[-1]][1] == e and len(inside) <= MAX_PIECES:
                    gold[inside[0], inside[-1] + 1] = 1 + KINDS.index(kind)
                    covered |= set(inside)
            gold |= {(k, k + 1): 0 for k in range(len(lattice.at)) if k not in covered}
            cases.append((lattice, gold))
    w = np.zeros((FEATURES, 1 + len(KINDS)))
    seen = np.full_like(w, 1e-2)
    for _ in range(rounds):
        rnd.shuffle(cases)
        for lattice, gold in cases:
            g = lattice.gradient(w, gold) - 1e-3 * w
            seen += g * g
            w += 0.5 * g / np.sqrt(seen)
    return w.tobytes()


def find(text: str | None, w: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of one text, by kind, then start."""
    if not text or not _SIGN.search(text):
        return [], []
    base = base_spans(text)
    starts, ends = [], []  # of the union of the base spans
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    added = []
    for start, end in stretches(text):
        for kind, a, b in best_entities(text, start, end, w):
            k = bisect_right(ends, a)
            if k == len(ends) or starts[k] >= b:
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, keep: list[Column | str] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, base counts, ``base_sha256``, ``spans`` and
    ``redacted`` (every span replaced by its kind in brackets)."""
    held = docs.select("doc_id", *keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(np.frombuffer(fitted()).reshape(FEATURES, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            found = [find(x, w) for x in texts]
            cols = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
            cols += [pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found]), pa.array([_listed(every) for _, every in found]),
                     pa.array([redact(x, every) for x, (_, every) in zip(texts, found, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + cols,
                                             names=[*b.schema.names[:-1], *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "redacted"])

    return held.mapInArrow(run, extended(held.schema.fields[:-1], ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, redacted string"))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with the union of overlapping spans replaced by ``[KIND]`` of the first."""
    if not spans:
        return text
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]
