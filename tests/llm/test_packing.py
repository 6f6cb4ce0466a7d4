"""Packing: exact round trip against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing

TEXTS = ["", None, "a", "  two  blanks \n\n lines\n", "tab\there and there   wide \x1c sep", "it's we'll <|endoftext|> don't",
         "x" * 5000, "été naïve 中文 \U0001f600 123 4567,,, ###", "word " * 3000, "word " * 3000, "\n", " ", "a \t b  　c"]


def _reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def _check(rows, docs, window=1024):
    t = _reference()
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in docs}
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    seqs = {}
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], dtype="<u4").tobytes())
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i in want:
        mine = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
    for s, pieces in seqs.items():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
        total = sum(n for _, n in pieces)
        assert total == window or s == max(seqs) and total <= window


def test_pieces_round_trip(spark):
    docs = list(enumerate(TEXTS))
    df = spark.createDataFrame([(i, x, "p", "s") for i, x in docs], "doc_id long, text string, part string, row string")
    _check(packing.pack(df.repartition(3)).collect(), docs)


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "no id"), (None, None)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows) and len(rows) == 4
    assert packing.pack(df.where("doc_id = 9")).count() == 0


def test_ids_rebuild_the_documents(spark, t):
    rows = packing.pack(t.documents, with_ids=True).collect()
    docs = [(r.doc_id, r.text) for r in t.documents.collect()]
    _check(rows, docs)
    ref, whole = _reference(), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, dtype="<u2").tolist())
    assert all(whole[i] == [*ref.encode(x, add_special_tokens=False).ids, 0] for i, x in docs)


def test_prefix_sums_over_many_partitions(spark):
    tokens = spark.range(0, 57).select((F.col("id") * 3).cast("int").alias("part"), (F.col("id") + 1).alias("doc_tokens"))
    got = {r.part: r.base for r in packing.offsets(tokens, bucket=10).collect()}
    assert got == {3 * i: sum(range(1, i + 1)) for i in range(57)}


def test_the_memo_is_bounded_in_bytes(monkeypatch):
    """Texts without blanks, and many distinct short pieces, in a process of their own."""
    import subprocess
    import sys

    code = """
import random, resource
from tessera.llm.packing import Encoder
rnd, e = random.Random(1), Encoder()
e("warm up"); base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for k in range(100_000):
    e("".join(map(chr, rnd.choices(range(0x4E00, 0x5E00), k=40 if k % 20 else 1500))))
    e(f"{rnd.random()} {rnd.random()}")
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert int(out.stdout) < 300, out.stdout


def test_ids_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="16 bits"):
        packing.tokenise(df, end_id=70_000).collect()
