"""SMP — proportional samples that sum exactly, and their bias audit.

Largest-remainder apportionment uses integer arithmetic (``n*size div total``
and ``n*size mod total``) so the result is exact in both engines. Draws are
deterministic per seed: rows are ranked inside their stratum by
``md5(seed ':' key)``, a hash both Spark and DuckDB compute identically.
Rows whose hash is far above the quota's share are dropped before the shuffle; ranking what
is left of a stratum is a two-stage top-k (per stratum and hash salt, then per stratum),
each stage bounded by the quota.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import bounded
from ..session import ensure_checkpoint_dir

SALT_BUCKETS = 64
SPARE = 2.0  # times a quota's share of the hashes that is looked through first


def apportion(sizes: DataFrame, n: int) -> DataFrame:
    """sizes(stratum, size) -> (stratum, size, seats). Floors first, then one
    extra seat for the largest remainders (name ascending on ties); sums to
    ``min(n, total)``; never more than a stratum holds. The strata table has
    one row per stratum, so its single window is small."""
    tot = F.sum("size").over(Window.partitionBy())
    s = (sizes.withColumn("_tot", tot)
         .withColumn("_n", F.least(F.lit(n), F.col("_tot")).cast("long"))
         .withColumn("_floor", F.when(F.col("_n") <= 0, F.lit(0)).otherwise(F.expr("(_n * size) div _tot")))
         .withColumn("_rem", F.expr("(_n * size) % _tot")))
    s = s.withColumn("_left", F.col("_n") - F.sum("_floor").over(Window.partitionBy()))
    s = s.withColumn("_order", F.row_number().over(Window.orderBy(F.desc("_rem"), "stratum")))
    return s.select("stratum", "size", (F.col("_floor") + F.when(F.col("_order") <= F.col("_left"), 1).otherwise(0))
                    .cast("long").alias("seats"))


def _draws(df: DataFrame, stratum_col: str, key_col: str, n: int, seeds: list[int]) -> DataFrame:
    """(key, stratum) of the rows that each seed draws: the quota's least hashes of every
    (seed, stratum). Hashes are uniform, so a stratum's least lie under ``SPARE`` times the
    quota's share of them but by rare chance or with many equal keys. Rows above that bound
    are dropped as they are read, and a (seed, stratum) that is left with fewer rows than its
    quota is read again without the bound."""
    sizes = df.groupBy(F.col(stratum_col).alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    share = F.least(F.lit(1.0), (F.lit(SPARE) * F.col("seats") + 100) / F.col("size"))
    bound = F.when(share < 1, F.lpad(F.lower(F.hex((share * (1 << 48)).cast("long"))), 12, "0"))
    quotas = bounded(apportion(sizes, n).where("seats > 0").select("stratum", "seats", bound.alias("_bound")))
    of_seed = df.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")
    x = df.select(F.col(key_col).alias("key"), F.col(stratum_col).alias("stratum")).crossJoin(F.broadcast(of_seed)).join(quotas, "stratum")
    x = x.withColumn("_h", F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("key").cast("string"))))
    under = F.col("_h").isNull() | F.col("_bound").isNull() | (F.col("_h") < F.col("_bound"))
    ensure_checkpoint_dir(df.sparkSession)
    kept = x.where(under).drop("_bound").checkpoint()
    held = kept.groupBy("seed", "stratum").agg(F.count(F.lit(1)).alias("_n"))
    short = quotas.crossJoin(F.broadcast(of_seed)).join(held, ["seed", "stratum"], "left").where(F.coalesce("_n", F.lit(0)) < F.col("seats")).select("seed", "stratum").checkpoint()
    if not short.isEmpty():
        kept = kept.unionByName(x.where(~under).drop("_bound").join(bounded(short), ["seed", "stratum"], "left_semi"))
    within = (F.col("_r") <= n) & (F.col("_r") <= F.col("seats"))
    kept = kept.withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(SALT_BUCKETS)))
    for by in (["seed", "stratum", "_salt"], ["seed", "stratum"]):
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "key"))).where(within).drop("_r")
    return kept.select("key", "stratum")


def stratified_sample(df: DataFrame, stratum_col: str, key_col: str, n: int, seed: int) -> DataFrame:
    """Draw each stratum's quota deterministically by seed; n ≥ size → all rows,
    n ≤ 0 → none. Returns (key, stratum)."""
    return _draws(df, stratum_col, key_col, n, [seed])


def inclusion_audit(df: DataFrame, stratum_col: str, key_col: str, n: int, seeds: list[int], edge: int) -> DataFrame:
    """Over many seeds: how often the ``edge`` lowest and highest keys are drawn,
    and the high/low ratio (≈ 1 when high ids are not under-drawn). All seeds
    are drawn in one job: rows × seeds (a short list, broadcast), of which only the
    least hashes of a (seed, stratum) leave the task that read them."""
    draws = _draws(df, stratum_col, key_col, n, seeds).select("key")
    base = df.select(F.col(key_col).alias("key"))
    low = base.orderBy("key").limit(edge).withColumn("_side", F.lit("low"))
    high = base.orderBy(F.desc("key")).limit(edge).withColumn("_side", F.lit("high"))
    hits = draws.join(F.broadcast(low.unionByName(high)), "key")
    denom = float(edge * len(seeds))
    out = hits.agg(F.count_if(F.col("_side") == "low").alias("low_hits"),
                   F.count_if(F.col("_side") == "high").alias("high_hits"))
    return out.select(F.round(F.col("low_hits") / F.lit(denom), 4).alias("low_rate"),
                      F.round(F.col("high_hits") / F.lit(denom), 4).alias("high_rate"),
                      F.round(F.try_divide(F.col("high_hits").cast("double"), F.col("low_hits").cast("double")), 4).alias("ratio"))
