"""REL — the relational query shapes the harness asks and grades.

Each function takes a namespace of the base tables (``t.lineitem`` …) and
returns a lazy DataFrame. Plans are written to shrink data before it moves:
fact tables are pre-aggregated on the join key before they meet a dimension,
dimensions are broadcast only behind a row-count bound (``plans.joins``), and
filters sit directly on scans so they reach parquet as pushed filters.
Money is rounded to 2 places and ratios to 4, the same on the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import bounded, one_row
from ..plans.ordered import ordered_scan, previous_value

def revenue():
    return F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _ymd(c):
    return F.date_format(c, "yyyy-MM-dd")


def count_all(t) -> DataFrame:
    return t.customer.agg(F.count(F.lit(1)).alias("n"))


def project(t) -> DataFrame:
    return t.customer.select("c_name", "c_mktsegment")


def join_filter_avg(t, region: str = "EUROPE") -> DataFrame:
    dims = (t.nation.join(bounded(t.region.where(F.col("r_name") == region)),
                          F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_nationkey")))
    return (t.customer.join(bounded(dims), F.col("c_nationkey") == F.col("n_nationkey"))
            .agg(F.round(F.avg("c_acctbal"), 4).alias("avg_acctbal")))


def left_join_count(t) -> DataFrame:
    """Histogram of line items per order, empty orders kept (count of a column,
    not of rows). Line items are counted per order *before* the join."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_n"))
    lines = (t.orders.select("o_orderkey")
             .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
             .select(F.coalesce(F.col("_n"), F.lit(0)).alias("n_lines")))
    return lines.groupBy("n_lines").agg(F.count(F.lit(1)).alias("n_orders"))


def is_null(t) -> DataFrame:
    return (t.documents.join(t.labels.select(F.col("doc_id").alias("l_doc_id")),
                             F.col("doc_id") == F.col("l_doc_id"), "left")
            .where(F.col("l_doc_id").isNull())
            .select("doc_id", "lang"))


def sum_filter(t) -> DataFrame:
    return (t.orders.where(F.col("o_orderstatus") == "F")
            .agg(F.round(F.sum("o_totalprice"), 2).alias("total")))


def _revenue_by_part(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_partkey").agg(F.sum(revenue()).alias("_rev"))


def top1_revenue(t) -> DataFrame:
    by_type = (_revenue_by_part(t.lineitem)
               .join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
               .groupBy("p_type").agg(F.sum("_rev").alias("_rev")))
    return (by_type.orderBy(F.desc("_rev"), "p_type").limit(1)
            .select("p_type", F.round("_rev", 2).alias("revenue")))


def self_join_left(t) -> DataFrame:
    cur = t.conversations.select("conv_id", "turn", "role")
    prev = t.conversations.select(F.col("conv_id").alias("p_conv"),
                                  (F.col("turn") + 1).alias("p_next"),
                                  F.col("role").alias("prev_role"))
    return (cur.join(prev, (F.col("conv_id") == F.col("p_conv")) & (F.col("turn") == F.col("p_next")), "left")
            .select("conv_id", "turn", "role", "prev_role"))


def gt_scalar_avg(t) -> DataFrame:
    avg = one_row(t.customer.agg(F.avg("c_acctbal").alias("_avg")))
    return (t.customer.crossJoin(avg).where(F.col("c_acctbal") > F.col("_avg"))
            .select("c_custkey", "c_name", "c_acctbal"))


def join_count(t) -> DataFrame:
    per_cust = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return (t.customer.join(per_cust, F.col("c_custkey") == F.col("o_custkey"))
            .select("c_custkey", "c_name", "n_orders"))


def top1_sum(t) -> DataFrame:
    per_nation = t.customer.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("_tot"))
    return (per_nation.join(bounded(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .orderBy(F.desc("_tot"), "n_name").limit(1)
            .select("n_name", F.round("_tot", 2).alias("total_acctbal")))


def range_count(t, start: str = "1998-01-01") -> DataFrame:
    return (t.orders.where(F.col("o_orderdate") >= _ts(start))
            .agg(F.count(F.lit(1)).alias("n_orders")))


def group_extreme(t) -> DataFrame:
    """Richest customer(s) per nation; ties all kept. The maximum is a partial
    aggregate (no sort, no window), then an equi-join on (nation, balance)."""
    top = t.customer.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("_max"))
    return (t.customer.join(top, (t.customer.c_nationkey == top.c_nationkey)
                            & (F.col("c_acctbal") == F.col("_max")), "left_semi")
            .select("c_nationkey", "c_custkey", "c_name", "c_acctbal"))


def anti_join(t) -> DataFrame:
    return (t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
            .select("o_orderkey"))


def semi_join(t) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id", "lang")


def ratio_case(t) -> DataFrame:
    return t.orders.agg(
        F.round(F.lit(100.0) * F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
                / F.count(F.lit(1)), 4).alias("pct_f"))


def multi_hop(t) -> DataFrame:
    """Revenue by region. Each hop aggregates before it joins, so the fact rows
    shrink to one per order, then one per customer, then one per nation."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("_rev"))
    per_cust = (per_order.join(t.orders.select("o_orderkey", "o_custkey"),
                               F.col("l_orderkey") == F.col("o_orderkey"))
                .groupBy("o_custkey").agg(F.sum("_rev").alias("_rev")))
    per_nation = (per_cust.join(t.customer.select("c_custkey", "c_nationkey"),
                                F.col("o_custkey") == F.col("c_custkey"))
                  .groupBy("c_nationkey").agg(F.sum("_rev").alias("_rev")))
    geo = t.nation.join(bounded(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return (per_nation.join(bounded(geo), F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("r_name").agg(F.round(F.sum("_rev"), 2).alias("revenue")))


def self_join_top1(t) -> DataFrame:
    pairs = self_join_left(t).where(F.col("prev_role").isNotNull())
    return (pairs.groupBy("prev_role", F.col("role").alias("next_role"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "prev_role", "next_role").limit(1))


def count_distinct(t) -> DataFrame:
    """Distinct customers per brand. (order, brand) pairs are made distinct
    before meeting orders, so the wide join carries no duplicate lines."""
    order_brand = (t.lineitem.select("l_orderkey", "l_partkey")
                   .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
                   .select("l_orderkey", "p_brand").distinct())
    cust_brand = (order_brand.join(t.orders.select("o_orderkey", "o_custkey"),
                                   F.col("l_orderkey") == F.col("o_orderkey"))
                  .select("p_brand", "o_custkey"))
    return cust_brand.groupBy("p_brand").agg(F.countDistinct("o_custkey").alias("n_customers"))


def having_scalar(t) -> DataFrame:
    overall = one_row(t.customer.agg(F.avg("c_acctbal").alias("_g")))
    per = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("_a"))
    return (per.crossJoin(overall).where(F.col("_a") > F.col("_g"))
            .join(bounded(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("n_name", F.round("_a", 4).alias("avg_acctbal")))


def reconcile(t) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("_lt"))
    j = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    diff = F.col("o_totalprice") - F.col("_lt")
    return j.select("o_orderkey", "o_totalprice",
                    F.round("_lt", 2).alias("line_total"),
                    F.round(diff, 2).alias("difference"),
                    (F.abs(diff) < 0.005).alias("matches"))


def range_closed(t, start: str = "1997-01-01", end_exclusive: str = "1997-04-01") -> DataFrame:
    """Closed date range [start, last day] written as a half-open timestamp range,
    which is exact for any time of day and pushes to parquet as two bounds."""
    return (t.orders.where((F.col("o_orderdate") >= _ts(start)) & (F.col("o_orderdate") < _ts(end_exclusive)))
            .agg(F.count(F.lit(1)).alias("n_orders")))


def top1_filter_across(t, status: str = "F") -> DataFrame:
    f_orders = t.orders.where(F.col("o_orderstatus") == status).select("o_orderkey")
    per_part = (t.lineitem.join(f_orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
                .groupBy("l_partkey").agg(F.sum(revenue()).alias("_rev")))
    by_type = (per_part.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
               .groupBy("p_type").agg(F.sum("_rev").alias("_rev")))
    return (by_type.orderBy(F.desc("_rev"), "p_type").limit(1)
            .select("p_type", F.round("_rev", 2).alias("revenue")))


def union(t) -> DataFrame:
    return (t.nation.select(F.col("n_name").alias("name"))
            .union(t.region.select(F.col("r_name").alias("name"))).distinct())


def _parts_sold_in_region(t, region: str) -> DataFrame:
    supp = (t.supplier.join(bounded(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(bounded(t.region.where(F.col("r_name") == region)), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey"))
    return (t.lineitem.join(supp, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
            .select("l_partkey"))


def except_intersect(t, a: str = "AMERICA", b: str = "EUROPE") -> DataFrame:
    """Parts sold by suppliers of region ``a`` and of ``b`` (INTERSECT), and by
    ``a`` only (EXCEPT). Both set operators are distinct, as in SQL."""
    sa, sb = _parts_sold_in_region(t, a), _parts_sold_in_region(t, b)
    both = sa.intersect(sb).withColumn("kind", F.lit("both"))
    only_a = sa.subtract(sb).withColumn("kind", F.lit("only_a"))
    return both.unionByName(only_a)


def cte(t) -> DataFrame:
    rev = t.lineitem.groupBy("l_orderkey").agg(F.sum(revenue()).alias("revenue"))
    return (rev.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_orderpriority")
            .agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("revenue"), 2).alias("revenue")))


def window(t) -> DataFrame:
    """Per customer, orders in date order: sequence, running total and the
    previous order date. A customer holding a third of all orders is still
    spread over many tasks (``plans.ordered``); the lag is an equi-join on
    (customer, seq - 1), not a window."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    seq = ordered_scan(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], seq="order_seq",
                       sums={"running_total": F.col("o_totalprice")})
    lagged = previous_value(seq, ["o_custkey"], "order_seq", ["o_orderdate"])
    return lagged.select("o_orderkey", "o_custkey", "order_seq",
                         F.round("running_total", 2).alias("running_total"),
                         _ymd(F.col("prev_o_orderdate")).alias("prev_orderdate"))


def distinct_limit(t, n: int = 10) -> DataFrame:
    return (t.part.select("p_brand").where(F.col("p_brand").isNotNull())
            .distinct().orderBy("p_brand").limit(n))


def cap(df: DataFrame, requested: int | None = None, max_rows: int = 500) -> DataFrame:
    """Row cap: add a limit, tighten a larger one, keep a smaller one. Applied to
    the whole frame, so a set operation is capped as a whole."""
    n = max_rows if requested is None else min(requested, max_rows)
    return df.limit(n)


def row_cap(t, requested: int = 50, max_rows: int = 20) -> DataFrame:
    ranked = t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return cap(ranked, requested, max_rows)
