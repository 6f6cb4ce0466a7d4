"""PTH keys on the co-purchase graph (customer – part – supplier)."""

from pyspark.sql import functions as F

from ..operators import paths as PT
from ..sources.tables import load_tables
from .registry import register

SOURCE = "c0"


def copurchase_edges(t):
    cp = (t["lineitem"].select("l_orderkey", "l_partkey")
          .join(t["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
          .select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
                  F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")))
    ps = t["lineitem"].select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
                              F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    return cp.unionByName(ps.distinct())


EDGES_SQL = """e0 AS (SELECT DISTINCT concat('c', CAST(o_custkey AS VARCHAR)) AS src, concat('p', CAST(l_partkey AS VARCHAR)) AS dst
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       UNION SELECT DISTINCT concat('p', CAST(l_partkey AS VARCHAR)), concat('s', CAST(l_suppkey AS VARCHAR)) FROM lineitem),
e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0),
lv(node, hops) AS (
  SELECT 'c0', 0
  UNION
  SELECT e.dst, lv.hops + 1 FROM lv JOIN e ON e.src = lv.node WHERE lv.hops < 24),
h AS (SELECT node, min(hops) AS hops FROM lv GROUP BY node)"""


# The recursion's bound is far above the graph's diameter; the Spark side has none.
@register("pth_shortest", f"""WITH RECURSIVE {EDGES_SQL}
SELECT 'c0' AS source, h.node AS node, h.hops AS hops, min(p.node) AS via
FROM h JOIN e ON e.dst = h.node JOIN h p ON p.node = e.src AND p.hops = h.hops - 1
WHERE h.hops > 0 GROUP BY h.node, h.hops""")
def pth_shortest(spark, d):
    t = load_tables(spark, d, register=False)
    src = spark.createDataFrame([(SOURCE,)], "node string")
    return PT.shortest_paths(copurchase_edges(t), src)


# Declared references of the test schema.
REFERENCES = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
              ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
              ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
              ("nation", "n_regionkey", "region", "r_regionkey")]


@register("pth_join_along", """
SELECT o_orderkey, o_custkey, c_nationkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def pth_join_along(spark, d):
    """Orders joined to region along the shortest reference path that is found."""
    t = load_tables(spark, d, register=False)
    refs = spark.createDataFrame(REFERENCES, "table string, column string, ref_table string, ref_column string")
    path = PT.join_path(refs, "orders", "region")
    return PT.join_along(t, path).select("o_orderkey", "o_custkey", "c_nationkey", "n_name", "r_name")
