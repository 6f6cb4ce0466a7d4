"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (whole text, cut at white space about every
``PASSAGE`` bytes). Each passage becomes a vector: shares of characters by class,
shares of adjacent class pairs, and word statistics. A learned layer encodes it; gated
attention weights passages (``tanh(Vh) * sigmoid(Uh)``, softmax over the bag); the
weighted representation is scored by a logistic unit. Only document labels are used.

The model is fitted on at most ``max_documents`` labelled documents, those of smallest
hashed id; executors compute their passage vectors and only these reach the driver.

Defined cases: a text without words, null or empty, has one passage of zeros and so
the score the model gives to an empty passage; null labels or ids are not learned
from; without any labelled row every score is 1.0 (nothing is rejected); repeated
labels of an id are learned from once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended

PASSAGE = 320
MAX_DOCUMENTS = 3000
THRESHOLD = 0.3
HIDDEN, GATES = 24, 12

# Classes of bytes: lower, upper, digit, white space, stops, marks, other ASCII, non-ASCII.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 6
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?'\"()-", b"#*$%&|<>!")):
    _CLASS[list(_chars)] = _i
CLASSES = 8
FEATURES = CLASSES + CLASSES * CLASSES + 8


def passages(text: bytes | None) -> np.ndarray:
    """Vectors of all passages, one row each."""
    b = np.frombuffer(text or b"", dtype=np.uint8)
    cls = _CLASS[b]
    space = cls == 3
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros((1, FEATURES), np.float32)
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    last = np.flatnonzero(~space & np.concatenate((space[1:], [True])))
    of_word = first // PASSAGE
    _, begin, of_word = np.unique(of_word, return_index=True, return_inverse=True)
    n = len(begin)
    edges = first[begin]
    edges[0] = 0
    of_byte = np.repeat(np.arange(n), np.diff(np.append(edges, len(b))))
    size = np.bincount(of_byte, minlength=n).astype(np.float64)[:, None]
    single = np.bincount(of_byte * CLASSES + cls, minlength=n * CLASSES).reshape(n, -1)
    double = np.bincount((of_byte[:-1] * CLASSES + cls[:-1]) * CLASSES + cls[1:], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    words = np.bincount(of_word, minlength=n).astype(np.float64)
    length = last - first + 1
    # A word's sum of byte values by odd weights tells neighbours apart well enough.
    total = np.concatenate(([0], np.cumsum((b.astype(np.int64) * 2654435761 + 97) ** 2 & 0xFFFFFF)))
    key = total[last + 1] - total[first]
    same = np.concatenate(([False], (key[1:] == key[:-1]) & (of_word[1:] == of_word[:-1])))
    distinct = np.bincount(np.unique(of_word.astype(np.int64) << 40 | key & (1 << 40) - 1) >> 40, minlength=n)
    mean = np.bincount(of_word, length, minlength=n) / words
    tail = cls[last]
    stats = np.stack([np.bincount(of_word, same, minlength=n) / words, distinct / words, mean / 10,
                      np.bincount(of_word, length > 20, minlength=n) / words, np.bincount(of_word, tail == 5, minlength=n) / words,
                      np.bincount(of_word, cls[first] == 1, minlength=n) / words, np.bincount(of_word, tail == 4, minlength=n) / words,
                      np.minimum(words, 60) / 60], axis=1)
    return np.hstack([single / size, 4 * double / size, stats]).astype(np.float32)


def _forward(m: dict, x: np.ndarray, bag: np.ndarray, n: int):
    h = np.tanh(((x - m["mean"]) / m["std"]) @ m["W"] + m["b"])
    v, u = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-h @ m["U"]))
    a = (v * u) @ m["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag, a)
    e = np.exp(a - top[bag])
    a = e / np.bincount(bag, e, minlength=n)[bag]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, bag, a[:, None] * h)
    return h, v, u, a, z, 1 / (1 + np.exp(-np.clip(z @ m["o"] + m["c"], -30, 30)))


def fit(bags: list[np.ndarray], y: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.01, seed: int = 7) -> dict:
    """Encoder, gates and scorer by Adam on the log loss of document labels."""
    rng = np.random.default_rng(seed)
    every = np.vstack(bags)
    m = {"mean": every.mean(axis=0), "std": every.std(axis=0) + 0.02, "W": rng.normal(0, 0.1, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.3, (HIDDEN, GATES)), "U": rng.normal(0, 0.3, (HIDDEN, GATES)), "w": rng.normal(0, 0.3, GATES),
         "o": rng.normal(0, 0.3, HIDDEN), "c": np.zeros(1)}
    learned = ["W", "b", "V", "U", "w", "o", "c"]
    first, second = ({k: np.zeros_like(m[k]) for k in learned} for _ in range(2))
    for t in range(1, steps + 1):
        pick = rng.choice(len(bags), min(batch, len(bags)), replace=False)
        x = np.vstack([bags[i] for i in pick])
        bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
        h, v, u, a, z, p = _forward(m, x, bag, len(pick))
        d = (p - y[pick]) / len(pick)
        dz = d[:, None] * m["o"]
        da = (dz[bag] * h).sum(axis=1)
        da = a * (da - np.bincount(bag, a * da, minlength=len(pick))[bag])
        dv, du = da[:, None] * m["w"] * u * (1 - v * v), da[:, None] * m["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz[bag] + dv @ m["V"].T + du @ m["U"].T) * (1 - h * h)
        g = {"W": ((x - m["mean"]) / m["std"]).T @ dh, "b": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ da, "o": z.T @ d, "c": np.array([d.sum()])}
        step = rate * (1 - 0.9 * t / steps)
        for k in learned:
            grad = g[k] + 1e-4 * m[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * grad, 0.999 * second[k] + 0.001 * grad * grad
            m[k] = m[k] - step * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    return m


def score(model: dict | None, texts: list[bytes | None]) -> np.ndarray:
    """Scores of whole texts. Bags are stacked in groups of bounded size."""
    out = np.ones(len(texts))
    if model is None:
        return out
    at, stack, rows = 0, [], 0
    for i, text in enumerate(texts):
        stack.append(passages(text))
        rows += len(stack[-1])
        if rows > 4000 or i == len(texts) - 1:
            bag = np.repeat(np.arange(len(stack)), [len(s) for s in stack])
            out[at:i + 1] = _forward(model, np.vstack(stack), bag, len(stack))[-1]
            at, stack, rows = i + 1, [], 0
    return out


def train(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS) -> dict | None:
    """Model from ``labels(doc_id, quality)`` and the texts of those documents."""
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("h", "doc_id").limit(max_documents))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [passages(v).astype("<f4").tobytes() for v in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    got = (rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(vectors, f"doc_id {id_type}, quality int, x binary")
           .groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("v")).orderBy("doc_id").collect())
    if not got:
        return None
    bags = [np.frombuffer(r.v.x, "<f4").reshape(-1, FEATURES) for r in got]
    return fit(bags, np.array([float(r.v.quality == 1) for r in got]))


def classify(docs: DataFrame, model: dict | None, keep: list[Column | str] = ()) -> DataFrame:
    """The columns ``keep`` (``doc_id`` first), ``score`` and ``predicted`` of every document."""
    held = docs.select("doc_id", *keep, F.col("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(shared.value, b.column(b.num_columns - 1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))],
                names=[*b.schema.names[:-1], "score", "predicted"])

    return held.mapInArrow(run, extended(held.schema.fields[:-1], "score double, predicted int"))
