"""Order-dependent numbering and running totals that stay balanced under skew.

``row_number()`` / running ``sum()`` over ``Window.partitionBy(g)`` sends every
row of a group to one task. When one group may hold a third of all rows, that
task is the whole job. The helpers here compute the same values for groups of any
size, always by the same steps:

1. rows are range-partitioned on (group, whole order key), so a hot group is cut
   at its own quantiles; the partition number is the slice, and slice and rows are
   frozen by a reliable checkpoint (``spark.checkpoint.dir``), so no retry or
   second branch can see another cut;
2. a window over ``(group, slice)`` numbers rows / sums values inside each slice;
3. per-slice totals (at most one row per slice and group) become offsets through a
   window over the group, joined back null-safe on (group, slice).

NULL groups and NULL order keys behave as in the plain window: NULL is a group of
its own and sorts first. Rows that tie on the whole order key stay in one slice, so
the caller gives a total order (a unique tiebreak). Fractional sums are added as
decimals where all values so far are decimals of that size exactly, so that a cut cannot
change them; where one is not (finer, larger, infinite or not a number), as doubles,
slice after slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, shuffle_partitions

_S = "_slice"
SLICES_CONF = "tessera.ordered.slices"
SUM_TYPE = "decimal(38,6)"
EXACT_BELOW = 1e18  # so that no sum of less than 1e14 rows overflows


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def slices(spark) -> int:
    """Slices per scan: the session's shuffle partitions unless set."""
    return int(spark.conf.get(SLICES_CONF, str(shuffle_partitions(spark))))


def same(left: str, right: str, cols: list[tuple[str, str]]) -> Column:
    """Null-safe equality of aliased column pairs, usable as an equi-join."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{x}").eqNullSafe(F.col(f"{right}.{y}")) for x, y in cols])


def ordered_scan(df: DataFrame, group_cols: list[str], order_cols: list, seq: str | None = "seq",
                 sums: dict[str, Column] | None = None, n_slices: int | None = None) -> DataFrame:
    """Add ``seq`` (1-based row number) and running sums ``{name: expr}`` per group,
    in the order of ``order_cols``."""
    spark, columns, given = df.sparkSession, list(df.columns), list(sums or {})
    ensure_checkpoint_dir(spark)
    order = _cols(order_cols)
    staged = df.withColumns({f"_v_{name}": expr for name, expr in sums.items()}) if sums else df
    fractional = {name: isinstance(staged.schema[f"_v_{name}"].dataType, (T.DoubleType, T.FloatType)) for name in given}
    sums = list(given)
    for name in (n for n, yes in fractional.items() if yes):
        value = F.col(f"_v_{name}").cast("double")
        exact = F.when(F.abs(value) < EXACT_BELOW, value.try_cast(SUM_TYPE))
        inexact = (value.isNotNull() & ~F.coalesce(exact.cast("double") == value, F.lit(False))).cast("long")
        staged = staged.withColumns({f"_v_{name}": value, f"_v_{name}_exact": exact, f"_v_{name}_inexact": inexact})
        sums += [f"{name}_exact", f"{name}_inexact"]
    sliced = (staged.repartitionByRange(n_slices or slices(spark), *_cols(group_cols), *order)
              .withColumn(_S, F.spark_partition_id()).checkpoint())

    w_slice = Window.partitionBy(*group_cols, _S).orderBy(*order)
    w_run = w_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced
    if seq:
        local = local.withColumn("_lrn", F.row_number().over(w_slice))
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(w_run))

    aggs = [F.count(F.lit(1)).alias("_cnt")] + [F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    w_prev = Window.partitionBy(*group_cols).orderBy(_S).rowsBetween(Window.unboundedPreceding, -1)
    offs = sliced.groupBy(*group_cols, _S).agg(*aggs).select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)], F.col(_S).alias("_os"),
        F.coalesce(F.sum("_cnt").over(w_prev), F.lit(0)).alias("_o_cnt"),
        *[F.sum(f"_t_{name}").over(w_prev).alias(f"_o_{name}") for name in sums])

    pairs = [(g, f"_g{i}") for i, g in enumerate(group_cols)] + [(_S, "_os")]
    out = local.alias("l").join(offs.alias("o"), same("l", "o", pairs))
    added = {}
    if seq:
        added[seq] = (F.col("_lrn") + F.col("_o_cnt")).cast("int")

    def total(name: str) -> Column:
        # A NULL local sum means no value so far in this slice: earlier slices count alone.
        here, before = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        return F.when(here.isNull(), before).when(before.isNull(), here).otherwise(here + before)

    for name in given:
        if fractional[name]:
            exact = F.when(F.coalesce(total(f"{name}_inexact"), F.lit(0)) == 0, total(f"{name}_exact")).cast("double")
            added[name] = F.coalesce(exact, total(name))
        else:
            added[name] = total(name)
    return out.select(*[F.col(f"l.`{c}`") for c in columns if c not in added], *[v.alias(k) for k, v in added.items()])


def previous_value(df: DataFrame, group_cols: list[str], seq_col: str, value_cols: list[str],
                   prefix: str = "prev_") -> DataFrame:
    """``lag(v, 1)`` as an equi-join on ``(group, seq - 1)``: no hot key, since the
    join key includes the sequence number."""
    prev = df.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)], (F.col(seq_col) + 1).alias("_next"),
                     *[F.col(v).alias(prefix + v) for v in value_cols])
    pairs = [(g, f"_g{i}") for i, g in enumerate(group_cols)] + [(seq_col, "_next")]
    return df.alias("l").join(prev.alias("p"), same("l", "p", pairs), "left").select("l.*", *[prefix + v for v in value_cols])
