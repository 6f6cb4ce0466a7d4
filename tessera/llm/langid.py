"""Language identification by hierarchical discrimination.

A text is its hashed byte 1- to 4-gram profile (square-rooted counts, unit length) of the whole
lower-cased text. A linear family classifier (softmax) picks a language family; inside
it, one-versus-one linear SVMs (squared hinge) vote between the related languages.
``score`` is the family's probability times the winner's weakest pairwise probability
(a logistic curve fitted to the SVM margins).

The model is fitted on at most ``per_language`` labelled documents of each language,
those of smallest hashed id; profiles are computed by the executors, and only they
reach the driver (``per_language`` x languages x ``DIM`` floats). Families are a
parameter; a language outside the table belongs to the family ``other``.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a null
language or id is never learned from; with no labelled row at all every text is
``und``; repeated ids are learned from once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import extended

DIM_BITS = 12
DIM = 1 << DIM_BITS
PER_LANGUAGE = 500
SALTS = 32
UND = "und"

# Families of the languages such corpora hold.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ast", "ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "sino-japanese": ("ja", "ko", "zh"),
    "semitic": ("am", "ar", "he", "mt"),
}


def family_of(lang: str, families=None) -> str:
    return next((f for f, members in (families or FAMILIES).items() if lang in members), "other")


def profile(text: str) -> np.ndarray:
    """Hashed n-gram profile of a whole text, n from 1 to 4, over its UTF-8 bytes."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    out = np.zeros(DIM, dtype=np.float64)
    code, shift = b.copy(), np.uint32(32 - DIM_BITS)
    for n in range(1, 5):
        if n > 1:
            if len(code) < 2:
                break
            code = (code[:-1] << np.uint32(8)) | b[n - 1:]
        out += np.bincount((code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> shift, minlength=DIM)
    out = np.sqrt(out)
    return (out / np.linalg.norm(out)).astype(np.float32)


def _descend(grad, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam on a full-batch gradient."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, langs: list[str], families=None) -> dict:
    """Family weights and pairwise SVMs from profiles ``x`` and their languages."""
    names = sorted(set(langs))
    of = {n: family_of(n, families) for n in names}
    groups = sorted(set(of.values()))
    y = np.array(langs)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    model = {"groups": groups, "members": {g: [n for n in names if of[n] == g] for g in groups}, "pairs": {}}
    if len(groups) > 1:
        target = np.array([[of[n] == g for g in groups] for n in y], dtype=np.float32)
        target /= target.sum(axis=0) / len(groups) * len(groups) / len(y)  # families weigh the same
        weight = target.sum(axis=1, keepdims=True)
        one = (target > 0).astype(np.float32)
        model["family"] = _descend(lambda w: x.T @ (weight * (_softmax(x @ w) - one)) / weight.sum() + 1e-5 * w,
                                   np.zeros((x.shape[1], len(groups)), np.float32), 150, 0.3)
    for g in groups:
        members = model["members"][g]
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                rows = (y == a) | (y == b)
                z, s = x[rows], np.where(y[rows] == a, 1.0, -1.0).astype(np.float32)
                c = np.where(s > 0, 1 / (s > 0).sum(), 1 / (s < 0).sum()).astype(np.float32)
                w = _descend(lambda w, z=z, s=s, c=c: z.T @ (-2 * c * s * np.maximum(0, 1 - s * (z @ w))) + 1e-4 * w,
                             np.zeros(x.shape[1], np.float32), 150, 0.1)
                margin = z @ w
                k = _descend(lambda k, m=margin, s=s, c=c: np.array([np.sum(-c * s * m / (1 + np.exp(np.clip(s * m * k[0], -60, 60))))]) + 1e-3 * k,
                             np.ones(1), 100, 0.2)
                model["pairs"][a, b] = (w, float(max(k[0], 0.1)))
    return model


def predict(model: dict, text: str | None) -> tuple[str, float]:
    """Language and score of one text."""
    if not text or not model["groups"] or not any(map(str.isalpha, text)):
        return UND, 0.0
    x = np.append(profile(text), np.float32(1))
    if "family" in model:
        p = _softmax((x @ model["family"])[None, :])[0]
        g, score = model["groups"][int(p.argmax())], float(p.max())
    else:
        g, score = model["groups"][0], 1.0
    members = model["members"][g]
    votes = dict.fromkeys(members, 0)
    margins = {}
    for i, a in enumerate(members):
        for b in members[i + 1:]:
            w, k = model["pairs"][a, b]
            q = 1 / (1 + np.exp(-np.clip(k * float(x @ w), -60, 60)))
            margins[a, b], margins[b, a] = q, 1 - q
            votes[a if q >= 0.5 else b] += 1
    best = max(members, key=lambda n: (votes[n], sum(margins.get((n, o), 0) for o in members)))
    return best, score * float(min((margins[best, o] for o in members if o != best), default=1.0))


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, lang``: the ``per_language`` ids of smallest hash in each language.
    Ids are chosen first, so no text is sorted; the rank is limited before the shuffle."""
    out = labelled.select("lang", "doc_id").distinct().withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    out = out.withColumn("salt", F.pmod("h", F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):  # a hot language is ranked by many tasks first, then a bounded rest of it
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank")
    return out.select("doc_id", "lang")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, families=None) -> dict:
    """Model from rows ``doc_id, text, lang``; nulls and texts without letters are skipped."""
    rows = labelled.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    chosen = rows.join(F.broadcast(sample(rows, per_language)), ["doc_id", "lang"]).select("doc_id", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [(profile(v) if v else np.zeros(DIM, np.float32)).astype("<f4").tobytes() for v in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(x, pa.binary())], names=["doc_id", "lang", "x"])

    id_type = labelled.schema["doc_id"].dataType.simpleString()
    got = (chosen.mapInArrow(features, f"doc_id {id_type}, lang string, x binary").groupBy("doc_id", "lang")
           .agg(F.min("x").alias("x")).orderBy("lang", "doc_id").collect())
    if not got:
        return {"groups": [], "members": {}, "pairs": {}}
    return fit(np.array([np.frombuffer(r.x, "<f4") for r in got]), [r.lang for r in got], families)


def identify(docs: DataFrame, model: dict, keep: list[Column | str] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep``, ``lang_pred``, ``score`` of every document."""
    held = docs.select("doc_id", *keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [predict(shared.value, v) for v in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(b.num_columns - 1)] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*b.schema.names[:-1], "lang_pred", "score"])

    return held.mapInArrow(run, extended(held.schema.fields[:-1], "lang_pred string, score double"))
