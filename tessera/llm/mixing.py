"""Mix sources to target weights, in blocks that are drawn by index.

Sizes are words (``[^\\x20\\x09-\\x0D]+``). Sources, by code point with null last, weigh
1, 2, 3, 1, ...; targets share the words of all documents by weight, none above ``CAP``
times its source's own words, the excess shared again by weight.

1. A source's documents, in a pseudorandom order, are one stream of words, packed into
   blocks of ``BLOCK_WORDS`` (the last one may be shorter).
2. A source is drawn from in epochs, each a pseudorandom permutation of its block
   indices, until its target is met; the last draw of the last epoch is cut to the word.
   So a source needs a known number of draws, and no word is taken more than ``CAP`` times.
3. The mix is cut into shards of ``SHARD_BLOCKS`` slots. Each shard draws its multinomial
   source counts, with the sources' shares of all draws as probabilities. The running
   count over the shards numbers a source's draws. Draws beyond what a source needs are
   surplus; their slots go, in a permuted order, to the sources that were drawn too
   seldom, so the totals are exact.
4. Draw ``j`` of a source of ``n`` blocks is epoch ``j div n``, block
   ``permutation(j mod n)``; slots meet blocks in an equi-join on (source, block).

Permutations are swap-or-not shuffles: each round maps ``x`` to ``K - x`` modulo ``n`` or
not, as a hash of the pair says. Every round undoes itself, so the shuffle is a bijection
of ``[0, n)`` for any ``n`` and is inverted by its rounds backwards. All hashes have a
fixed seed, so reruns agree whatever the partitions.

Scale: nothing is broadcast but sources behind a count; running sums are cut inside a hot
source (``plans.ordered``); slots are counted before any shuffle; joins are by (source,
block), which a hot source spreads evenly. DataFrame functions only.

Defined cases: a null or blank text has size 0 and is taken 0 times; a source without
words has target 0; without any words nothing is drawn; null sources are one source;
repeated rows are rows of their own (equal ones differ at most in ``taken``); a null id is
ordered by its size. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import ordered_scan
from .common import bounded_broadcast, staged

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK_WORDS = 256
SHARD_BLOCKS = 1024
SEED = 20240229
ROUNDS = 24
MAX_BROADCAST_SOURCES = 100_000


class Mix(NamedTuple):
    sources: DataFrame  # sid, source, source_size, weight, target, n_blocks, full, rest, quota
    empty: DataFrame  # documents without words: doc_id, size, sid
    pieces: DataFrame  # sid, block, start, length (in the block), row, doc_id, size, first_word
    draws: DataFrame  # shard, slot, sid, epoch, block, words


def words_in(text: Column) -> Column:
    """Number of words; the text is rewritten once, no array of words is made."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def _hash(*parts: Column | int) -> Column:
    return F.xxhash64(*[(F.lit(p) if isinstance(p, int) else p).cast("long") for p in parts])


def permuted(x: Column, n: Column, *keys: Column | int, inverse: bool = False) -> Column:
    """Where the permutation of ``[0, n)`` named by ``keys`` takes ``x``."""
    rounds = F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(_hash(*keys, r) - x, n)
        return F.when(_hash(*keys, r, F.greatest(x, other)) % 2 == 0, x).otherwise(other)

    return F.aggregate(rounds, x.cast("long"), turn)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sid, source, source_size, weight, target`` of every source of ``sized(source, size)``.

    A source is capped if ``cap * size`` is under its weight's share. With the sources in
    rising order of ``size / weight``, the share a unit of weight is left with after the
    first ``k`` are capped rises while they must be, then falls: the level is its maximum.
    """
    sums = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    by = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights)).cast("int"))
    named = ordered_scan(sums.withColumn("last", F.col("source").isNull()), [], ["last", "source"], seq="sid").withColumn("sid", F.col("sid") - 1)
    named = staged(named.select("sid", "source", "source_size", by.alias("weight")), "sources")
    words, weight = named.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    run = ordered_scan(named, [], [F.col("source_size") / F.col("weight"), "sid"], seq=None,
                       sums={"size_through": F.col("source_size"), "weight_through": F.col("weight")})
    left = weight - F.col("weight_through") + F.col("weight")
    level = run.agg(F.max((words - cap * (F.col("size_through") - F.col("source_size"))) / left)).first()[0] or 0.0
    return named.withColumn("target", F.least((cap * F.col("source_size")).cast("double"), level * F.col("weight")))


def _quotas(sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Adds ``n_blocks, last_words, full, rest, short_at, quota``: a source takes ``full``
    whole epochs and ``rest`` words of one more, in which the short block is draw ``short_at``."""
    size = F.col("source_size")
    x = (sources.withColumn("n_blocks", F.ceil(size / block_words))
         .withColumn("last_words", size - (F.col("n_blocks") - 1) * block_words)
         .withColumn("goal", F.round("target").cast("long"))
         .withColumn("full", F.when(size > 0, F.floor(F.col("goal") / size)).otherwise(0))
         .withColumn("rest", F.col("goal") - F.col("full") * size)
         .withColumn("short_at", F.when(size > 0, permuted(F.col("n_blocks") - 1, F.col("n_blocks"), seed, F.col("sid"), F.col("full"), inverse=True))))
    plain = F.ceil(F.col("rest") / block_words)
    missing = block_words - F.col("last_words")
    some = F.when(plain <= F.col("short_at"), plain).otherwise(F.ceil((F.col("rest") + missing) / block_words))
    more = F.when(F.col("rest") > 0, some).otherwise(0)
    return x.withColumn("quota", F.when(size > 0, F.col("full") * F.col("n_blocks") + more).otherwise(0).cast("long")).drop("goal")


def _shard_counts(sources: DataFrame, slots: int, shard_blocks: int, seed: int) -> DataFrame:
    """``shard, sid, n``: each shard's multinomial draw. Its slots draw a number below
    ``slots``; the sources' shares are stretches of those numbers, found through a grid."""
    grid = 4 * sources.count() + 1024
    step = max(1, -(-slots // grid))
    stretch = ordered_scan(sources.where("quota > 0").select("sid", "quota"), [], ["sid"], seq=None, sums={"high": F.col("quota")}).withColumn("low", F.col("high") - F.col("quota"))
    cells = stretch.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))).alias("cell"))
    drawn = F.pmod(_hash(seed, F.col("id")), F.lit(slots))
    numbers = sources.sparkSession.range(slots).select(F.floor(F.col("id") / shard_blocks).alias("shard"), drawn.alias("u")).withColumn("cell", F.floor(F.col("u") / step))
    cells = bounded_broadcast(staged(cells, "cells"), 16 * MAX_BROADCAST_SOURCES)
    found = numbers.join(cells, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return staged(found.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")), "shard-counts")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("k")


def _draws(sources: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    counts = _shard_counts(sources, slots, shard_blocks, seed)
    before = Window.partitionBy("shard").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)  # at most the slots of a shard
    known = ["sid", "n_blocks", "last_words", "full", "rest", "short_at", "quota"]
    run = ordered_scan(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), ["sid"], ["shard"], seq=None, sums={"through": F.col("n")})
    run = run.withColumn("before", F.col("through") - F.col("n")).join(bounded_broadcast(sources.select(*known), MAX_BROADCAST_SOURCES), "sid")
    run = staged(run.withColumn("used", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), F.col("quota") - F.col("before")))), "running")
    direct = run.where("used > 0").select("shard", *known, "first", "before", _each("used")).select(
        "shard", (F.col("first") + F.col("k")).alias("place"), *known, (F.col("before") + F.col("k")).alias("j"))
    over = run.withColumn("over", F.col("n") - F.col("used")).where("over > 0").select("shard", "sid", "first", "used", "over")
    over = ordered_scan(over, [], ["shard", "sid"], seq=None, sums={"to": F.col("over")})
    over = staged(over.select("shard", "first", "used", "to", "over", _each("over")).select(
        "shard", (F.col("first") + F.col("used") + F.col("k")).alias("place"), (F.col("to") - F.col("over") + F.col("k")).alias("number")), "surplus")
    drawn = counts.groupBy("sid").agg(F.sum("n").alias("drawn"))
    short = sources.select(*known).join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    short = short.withColumn("lacks", F.col("quota") - F.col("drawn")).where("lacks > 0")
    short = ordered_scan(short, [], ["sid"], seq=None, sums={"to": F.col("lacks")})
    dealt = short.select(*known, "drawn", "to", "lacks", _each("lacks")).select(
        permuted(F.col("to") - F.col("lacks") + F.col("k"), F.lit(max(1, over.count())), seed, -1).alias("number"), *known, (F.col("drawn") + F.col("k")).alias("j"))
    settled = over.join(dealt, "number").select("shard", "place", *known, "j")
    each = direct.unionByName(settled)

    in_shard = F.least(F.lit(shard_blocks).cast("long"), slots - F.col("shard") * shard_blocks)
    epoch, at = F.floor(F.col("j") / F.col("n_blocks")), F.col("j") % F.col("n_blocks")
    each = each.select("shard", permuted(F.col("place"), in_shard, seed, -2, F.col("shard")).alias("slot"), *known, epoch.alias("epoch"), at.alias("at")).withColumn(
        "block", permuted(F.col("at"), F.col("n_blocks"), seed, F.col("sid"), F.col("epoch")))
    whole = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("last_words")).otherwise(F.lit(block_words))
    so_far = F.col("at") * block_words - F.when(F.col("at") > F.col("short_at"), block_words - F.col("last_words")).otherwise(0)
    words = F.when(F.col("epoch") == F.col("full"), F.least(whole, F.col("rest") - so_far)).otherwise(whole)
    return each.select("shard", "slot", "sid", "epoch", "block", words.cast("long").alias("words"))


def _pieces(sized: DataFrame, block_words: int, seed: int) -> DataFrame:
    """The documents' pieces in the blocks of their source's stream."""
    order = [_hash(seed, F.xxhash64("doc_id")), "doc_id", "size", "row"]
    stream = ordered_scan(sized.where("size > 0"), ["sid"], order, seq=None, sums={"end": F.col("size")}).withColumn("begin", F.col("end") - F.col("size"))
    blocks = F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words)))
    cut = stream.select("sid", "row", "doc_id", "size", "begin", "end", blocks.alias("block")).withColumn("low", F.greatest("begin", F.col("block") * block_words))
    high = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    return cut.select("sid", "block", (F.col("low") - F.col("block") * block_words).alias("start"), (high - F.col("low")).alias("length"),
                      "row", "doc_id", "size", (F.col("low") - F.col("begin")).alias("first_word"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> Mix:
    """The sources, the packed pieces and the draws of the mix of ``docs(doc_id, source, text)``."""
    sized = staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", words_in(F.col("text")).alias("size")), "sizes")
    sources = staged(_quotas(targets(sized, weights, cap), block_words, seed), "quotas")
    sids = bounded_broadcast(sources.select("sid", "source"), MAX_BROADCAST_SOURCES).alias("s")
    placed = sized.alias("d").join(sids, F.col("d.source").eqNullSafe(F.col("s.source"))).select("row", "doc_id", "size", "sid")
    return Mix(sources, placed.where("size = 0"), _pieces(placed, block_words, seed), staged(_draws(sources, block_words, shard_blocks, seed), "draws"))


def taken(m: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    uses = m.draws.groupBy("sid", "block", "words").agg(F.count(F.lit(1)).alias("times"))
    inside = F.greatest(F.lit(0).cast("long"), F.least(F.col("length"), F.col("words") - F.col("start")))
    met = m.pieces.join(uses, ["sid", "block"], "left").groupBy("row", "doc_id", "size", "sid").agg(
        F.coalesce(F.sum(F.col("times") * inside), F.lit(0)).alias("taken"))
    every = met.select("doc_id", "size", "sid", "taken").unionByName(m.empty.select("doc_id", "size", "sid", F.lit(0).cast("long").alias("taken")))
    return every.join(bounded_broadcast(m.sources.select("sid", "source_size", "target"), MAX_BROADCAST_SOURCES), "sid").select(
        "doc_id", "size", "source_size", "target", "taken")


def mixed_pieces(m: Mix) -> DataFrame:
    """``shard, slot, start, doc_id, first_word, n_words``: what fills each slot, in order of
    ``start``; slots hold ``BLOCK_WORDS`` words but for short and cut blocks."""
    n = F.least(F.col("length"), F.col("words") - F.col("start"))
    return m.draws.join(m.pieces, ["sid", "block"]).where("start < words").select("shard", "slot", "start", "doc_id", "first_word", n.alias("n_words"))


def mixed_texts(m: Mix, docs: DataFrame) -> DataFrame:
    """``mixed_pieces`` with their words, joined by blanks; needs unique ids."""
    words = F.slice(F.split(F.regexp_replace(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+", " "), " "), F.col("first_word") + 1, F.col("n_words"))
    return mixed_pieces(m).join(docs.select("doc_id", "text"), "doc_id").select("shard", "slot", "start", "doc_id", "first_word", "n_words", F.concat_ws(" ", words).alias("text"))
