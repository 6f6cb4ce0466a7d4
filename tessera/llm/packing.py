"""Concatenate and cut: documents into fixed windows of token ids.

Two passes. The first tokenises every text once and writes, per input partition,
the ids with the running token offset inside that partition. The partition totals
(one row per partition) become prefix sums, so ``offset in partition + offset of
the partition`` is the place of a document in one global stream of ids. The second
pass cuts that stream every ``window`` ids: a document that crosses a window
border yields one boundary record per window it touches.

Only the last window can be short, so padding is below ``window`` ids in all.

Defined cases: a null text is an empty text and holds the closing id alone;
repeated or null ids are separate documents; an empty table gives no pieces; extra
columns are ignored. The staged table fixes partition and row order, so a retried
task or a lost executor cannot renumber the stream.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, staged

WINDOW = 1024
END_ID = 0
VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO_BYTES = 100_000_000  # about, of a worker's memo
MEMO_PIECE = 40  # characters; longer pieces rarely come again
MAX_BROADCAST_PARTS = 1_000_000

# White space other than blank and line feed; texts that hold any are encoded whole.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
# A pre-token never crosses from a non-space to a following space, so a text may be
# cut there and its pieces encoded one by one.
_PIECE = re.compile("[ \n]*[^ \n]+|[ \n]+")


class _Memo(dict):
    """Piece of text -> its ids as little-endian 32-bit bytes, bounded in bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, piece):
        ids = np.array(self.encode(piece), dtype="<u4").tobytes()
        if len(piece) <= MEMO_PIECE:
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self.held += sys.getsizeof(piece) + sys.getsizeof(ids) + 100
            self[piece] = ids
        return ids


class Encoder:
    """Byte-level BPE ids of whole texts, with a bounded memo of pieces."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.largest = max(ranks.values())
        self.memo = _Memo(enc.encode_ordinary)

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit values."""
        if not text:
            return b""
        if _RARE_SPACE.search(text):
            return np.array(self.memo.encode(text), dtype="<u4").tobytes()
        return b"".join(map(self.memo.__getitem__, _PIECE.findall(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder per worker process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def tokenise(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, row, before, doc_tokens, ids``: ids as 16-bit values closed by
    ``end_id``; ``before`` counts the tokens ahead of it in its partition."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    if end_id > 0xFFFF:
        raise ValueError(f"{end_id} does not fit 16 bits")
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row, before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        if encode.largest > 0xFFFF:
            raise ValueError(f"ids of {vocabulary} do not fit 16 bits")
        for b in batches:
            ids, at, n = [], [], []
            for text in b.column("text").to_pylist():
                x = np.frombuffer(encode(text), dtype="<u4").astype("<u2").tobytes() + end
                ids.append(x)
                at.append(before)
                n.append(len(x) // 2)
                before += n[-1]
            k = len(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([part] * k, pa.int32()), pa.array(range(row, row + k), pa.int64()),
                 pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "part", "row", "before", "doc_tokens", "ids"])
            row += k

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, part int, row long, before long, doc_tokens long, ids binary")


def offsets(tokens: DataFrame, bucket: int = 1000) -> DataFrame:
    """``part -> base``: tokens ahead of each partition. Two levels of prefix sums,
    over buckets of partitions and inside each, so no task sees more than a bucket
    of partitions or one row per bucket."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).withColumn("b", F.floor(F.col("part") / bucket))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    per = totals.groupBy("b").agg(F.sum("n").alias("n")).select(
        "b", F.coalesce(F.sum("n").over(ahead.orderBy("b")), F.lit(0)).alias("b_base"))
    inside = totals.select("part", "b", F.coalesce(
        F.sum("n").over(Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("p_base"))
    return inside.join(per, "b").select("part", (F.col("b_base") + F.col("p_base")).alias("base"))


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    (plus ``ids``, the piece's 16-bit ids, if asked for)."""
    tokens = staged(tokenise(docs, vocabulary, end_id), "tokens")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    placed = tokens.join(bounded_broadcast(offsets(tokens), MAX_BROADCAST_PARTS), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("at"), "doc_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("at", "doc_tokens"))
            first, last = at // window, (at + n - 1) // window
            pieces = last - first + 1
            doc = np.repeat(np.arange(len(at)), pieces)
            seq = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = np.maximum(seq * window, at[doc])
            hi = np.minimum((seq + 1) * window, (at + n)[doc])
            start, length = lo - at[doc], hi - lo
            ids = b.column("ids").to_pylist()
            crc, kept, wide, of = [], [], b"", -1
            for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                if d != of:
                    of, wide = d, np.frombuffer(ids[d], dtype="<u2").astype("<u4").tobytes()
                crc.append(zlib.crc32(wide[4 * s:4 * (s + k)]))
                if with_ids:
                    kept.append(ids[d][2 * s:2 * (s + k)])
            cols = [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(n[doc]), pa.array(seq), pa.array(lo - seq * window)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = (f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long" + (", ids binary" if with_ids else ""))
    return placed.mapInArrow(cut, schema)
