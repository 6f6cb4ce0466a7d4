"""Quality rules by distribution divergence.

Two histograms of each whole text, its characters by class and its common words, are
compared with references of every language by Jensen-Shannon distance (0 to 1). The
common words are those in most documents of a language, counted exactly over the corpus
(a language needs ``MIN_DOCS`` documents), and a few listed ones. The references are sums
over all documents of a language that pass the base rules; the executors sum them, one
row per task and bin. Only a language whose own common words are ``MIN_MASS`` of its words
is a reference of the word histogram: any text without common words would fit another.
A text may quote another language,
so it is compared with the mixture of references that fits its words best (weights by
expectation maximisation; ``nearest`` is the heaviest). It fails if its distance
exceeds the limit of either histogram. Short texts scatter, so
the word limit grows by ``WORD_SLACK / sqrt(words)``, and a text under the guards'
minimum length is not judged by that histogram. A text of a language that is no such
reference (too few documents, or no words between blanks) is not judged by its words, but
by the characters of its own language.

Defined cases: a null text has no words, fails the base rule and is not kept; a text
without characters or words has distance 0; without any reference only the base rules
decide; a null language adds to no reference; repeated rows are judged one by one;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, staged

# Words that are bins beside those found in the corpus.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "en": "the of and a to in is that was he for it with as his on be at by i this had not are but from or have an they which",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son",
}
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "symbol", "other", "wide")
MIN_CHARS, MIN_WORDS = 100, 50
CHAR_LIMIT, WORD_LIMIT, WORD_SLACK = 0.3, 0.135, 1.9

TOP_WORDS, WORD_SHARE, WORD_BYTES = 32, 0.02, 64  # common words of a language: so many, in this share of its documents, no longer than this
MIN_DOCS, MIN_MASS = 10, 0.1
BLOCK = 512  # documents compared at a time
HELD_WORDS = 200_000  # a task counts so many words before it passes the counts on

_STOPS = b",.;:!?"
_CLASS = np.full(256, 8, np.uint8)
_CLASS[:128] = 7
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:!?'\"()-", b"#*$%&|<>")):
    _CLASS[list(_chars)] = _i
_CLASS[0x80:0xC0] = len(CLASSES)  # continuation bytes are part of the character before


class Vocabulary:
    """Bins of the word histogram, the last one for all other words, and those of each language."""

    def __init__(self, words: dict[str, list[bytes]]):
        words = {k: [*v, *(w.encode() for w in COMMON.get(k, "").split())] for k, v in words.items()}
        bins = {w: i for i, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        self.size = len(bins) + 1
        self.own = {k: sorted({bins[w] for w in ws}) for k, ws in words.items()}
        self.spellings = {w + stop: i for w, i in bins.items() for stop in (b"", *(bytes([c]) for c in _STOPS))}


def _document_words(text: bytes) -> set[bytes]:
    """Words of a text as the bins spell them; empty under the minimum length."""
    words = text.lower().split()
    if len(words) < MIN_WORDS:
        return set()
    out = {w[:-1] if w[-1] in _STOPS else w for w in set(words) if len(w) <= WORD_BYTES}
    return {w for w in out if w and (w.isalpha() or any(c >= 0x80 or 97 <= c <= 122 for c in w))}


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The common words of every language with enough documents, by the number of documents that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def counts():
            rows = [(lang, w, n) for lang, words in held.items() for w, n in words.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())],
                                              names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if words := _document_words(text or b""):
                    held[lang].update(words)
                    held[lang][b""] += 1  # the documents themselves
            if sum(map(len, held.values())) > HELD_WORDS:
                yield counts()
        yield counts()

    used = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sums = staged(used.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    size = {r.lang: r.n for r in sums.where((F.length("word") == 0) & (F.col("n") >= MIN_DOCS)).collect()}  # languages
    found: dict[str, list[tuple[int, bytes]]] = {k: [] for k in size}
    if size:
        least = F.create_map(*(F.lit(x) for k, n in size.items() for x in (k, max(2.0, WORD_SHARE * n))))
        # Words in so many documents are at most 1 / WORD_SHARE times the words of one document.
        for r in sums.where((F.length("word") > 0) & (F.col("n") >= F.try_element_at(least, F.col("lang")))).collect():
            found[r.lang].append((-r.n, bytes(r.word)))
    return Vocabulary({k: [w for _, w in sorted(v)[:TOP_WORDS]] for k, v in found.items()})


def measure(text: bytes | None, spellings: dict[bytes, int] = {}) -> tuple[int, int, int, int, int, np.ndarray, dict[int, int]]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, the characters by
    class and the common words by bin."""
    text = text or b""
    words = text.split()
    chars = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[:len(CLASSES)]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        found = np.array([times[x] > 1 for x in windows])
        covered = np.zeros(len(words), bool)
        for j in range(3):
            covered[j:j + len(found)] |= found
        repeated = int(covered.sum())
    common: dict[int, int] = Counter()
    for w, k in Counter(filter(spellings.__contains__, text.lower().split())).items():
        common[spellings[w]] += k
    return (len(words), int(chars.sum() - chars[3] - chars[4]), int(chars[6]), len(lines) - len(set(lines)), repeated, chars, common)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of ``p`` to ``q``, one histogram or as many
    rows; 0 if either is empty."""
    p, q = np.atleast_2d(np.asarray(p, np.float64)), np.atleast_2d(np.asarray(q, np.float64))
    size, ref = p.sum(axis=1, keepdims=True), q.sum(axis=1, keepdims=True)
    p, q = p / np.maximum(size, 1e-300), q / np.maximum(ref, 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        both = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where((size * ref)[:, 0] > 0, np.sqrt(np.clip(both / 2, 0, 1)), 0)


def shares(common: np.ndarray, references: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Weights of the references (rows, each summing to 1) in each row of word counts."""
    out = np.full((len(common), len(references)), 1 / len(references))
    for _ in range(rounds):
        ratio = common / np.maximum(out @ references, 1e-12)
        out = out * (ratio @ references.T) + 1e-12
        out /= out.sum(axis=1, keepdims=True)
    return out


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def measured(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """Counts and histograms of every document; of the words only bins that are not 0."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = docs.sparkSession.sparkContext.broadcast(words.spellings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings = shared.value
        for b in batches:
            got = [measure(x, spellings) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang")] + [pa.array([g[i] for g in got], pa.int64()) for i in range(5)]
                + [pa.array([base_failed(g[0], g[4]) for g in got], pa.bool_()), pa.array([g[5].tolist() for g in got], pa.list_(pa.int64())),
                   pa.array([list(g[6]) for g in got], pa.list_(pa.int32())), pa.array([list(g[6].values()) for g in got], pa.list_(pa.int64()))],
                names=["doc_id", "lang", *counts, "base_failed", "chars", "bins", "common"])

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, extended(rows.schema.fields[:2], ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, chars array<long>, bins array<int>, common array<long>"))


def _dense(b: pa.RecordBatch, size: int) -> np.ndarray:
    """Word histograms of a batch, one row each."""
    out = np.zeros((b.num_rows, size))
    for row, bins, common in zip(out, b.column("bins").to_pylist(), b.column("common").to_pylist(), strict=True):
        row[bins] = common
    out[:, -1] = np.array(b.column("n_words").to_pylist(), np.float64) - out.sum(axis=1)
    return out


def references(rows: DataFrame, words: Vocabulary) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Language -> summed histograms of its documents that pass the base rules."""
    n_chars, size = len(CLASSES), words.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                both = np.hstack([np.array(b.column("chars").to_pylist(), np.float64), _dense(b, size)])
                for lang, x in zip(b.column("lang").to_pylist(), both, strict=True):
                    sums[lang] = sums.get(lang, 0) + x
        found = [(lang, int(i), int(x[i])) for lang, x in sums.items() for i in np.flatnonzero(x)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["lang", "bin", "n"])

    used = rows.where(F.col("lang").isNotNull() & ~F.col("base_failed")).select("lang", "n_words", "chars", "bins", "common")
    out: dict[str, np.ndarray] = {}
    for r in used.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():  # languages x bins
        out.setdefault(r.lang, np.zeros(n_chars + size))[r.bin] = r.n
    return {k: (v[:n_chars], v[n_chars:]) for k, v in sorted(out.items())}


def judge(rows: DataFrame, refs: dict[str, tuple[np.ndarray, np.ndarray]], words: Vocabulary) -> DataFrame:
    """Adds ``char_distance, word_distance, nearest, kept``."""
    names = [k for k, (_, v) in refs.items() if k in words.own and v[words.own[k]].sum() >= MIN_MASS * v.sum()]
    by_chars, by_words = (np.array([refs[k][i] / max(refs[k][i].sum(), 1) for k in names]) for i in (0, 1))
    own_chars = {k: v[0] for k, v in refs.items() if k not in names}
    size = words.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                chars, common = np.array(b.column("chars").to_pylist(), np.float64), _dense(b, size)
                failed = np.array(b.column("base_failed").to_pylist(), bool)
                by_char, by_word, nearest = np.zeros(b.num_rows), np.zeros(b.num_rows), [None] * b.num_rows
                if names:
                    share = shares(common, by_words)
                    by_char, by_word = distance(chars, share @ by_chars), distance(common, share @ by_words)
                    nearest = [names[i] for i in share.argmax(axis=1)]
                for i, lang in enumerate(b.column("lang").to_pylist()):
                    if lang in own_chars:
                        by_char[i], by_word[i], nearest[i] = distance(chars[i], own_chars[lang])[0], 0.0, lang
                n = common.sum(axis=1)
                wrong = (chars.sum(axis=1) >= MIN_CHARS) & (by_char > CHAR_LIMIT) | (n >= MIN_WORDS) & (by_word > WORD_LIMIT + WORD_SLACK / np.sqrt(np.maximum(n, 1)))
                kept = b.select([x for x in b.schema.names if x not in ("lang", "chars", "bins", "common")])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(by_char), pa.array(by_word), pa.array(nearest, pa.string()), pa.array(~failed & ~wrong)],
                                                 names=[*kept.schema.names, "char_distance", "word_distance", "nearest", "kept"])

    fields = [f for f in rows.schema.fields if f.name not in ("lang", "chars", "bins", "common")]
    return rows.mapInArrow(run, extended(fields, "char_distance double, word_distance double, nearest string, kept boolean"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, distances, ``nearest``, ``kept``."""
    words = vocabulary(docs)
    rows = staged(measured(docs, words), "histograms")
    return judge(rows, references(rows, words), words)
