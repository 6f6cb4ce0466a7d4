"""REL keys: DataFrame operators and their DuckDB oracles."""

from ..operators import relational as R
from .registry import on_tables

REV = "l_extendedprice * (1 - l_discount)"

on_tables("rel_count_all", R.count_all, "SELECT count(*) AS n FROM customer")
on_tables("rel_project", R.project, "SELECT c_name, c_mktsegment FROM customer")
on_tables("rel_join_filter_avg", R.join_filter_avg, """
SELECT round(avg(c_acctbal), 4) AS avg_acctbal
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'EUROPE'""")
on_tables("rel_left_join_count", R.left_join_count, """
SELECT n_lines, count(*) AS n_orders FROM (
  SELECT o_orderkey, count(l_orderkey) AS n_lines
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) s
GROUP BY n_lines""")
on_tables("rel_is_null", R.is_null, """
SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.doc_id IS NULL""")
on_tables("rel_sum_filter", R.sum_filter,
          "SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'")
on_tables("rel_top1_revenue", R.top1_revenue, f"""
SELECT p_type, round(sum({REV}), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_type ORDER BY sum({REV}) DESC, p_type LIMIT 1""")
on_tables("rel_self_join_left", R.self_join_left, """
SELECT c.conv_id, c.turn, c.role, p.role AS prev_role
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""")
on_tables("rel_gt_scalar_avg", R.gt_scalar_avg, """
SELECT c_custkey, c_name, c_acctbal FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)""")
on_tables("rel_join_count", R.join_count, """
SELECT c_custkey, c_name, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey
GROUP BY c_custkey, c_name""")
on_tables("rel_top1_sum", R.top1_sum, """
SELECT n_name, round(sum(c_acctbal), 2) AS total_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name ORDER BY sum(c_acctbal) DESC, n_name LIMIT 1""")
on_tables("rel_range_count", R.range_count,
          "SELECT count(*) AS n_orders FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
on_tables("rel_group_extreme", R.group_extreme, """
SELECT c.c_nationkey, c.c_custkey, c.c_name, c.c_acctbal FROM customer c
WHERE c.c_acctbal = (SELECT max(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)""")
on_tables("rel_anti_join", R.anti_join, """
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
on_tables("rel_semi_join", R.semi_join, """
SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
on_tables("rel_ratio_case", R.ratio_case, """
SELECT round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 4) AS pct_f FROM orders""")
on_tables("rel_multi_hop", R.multi_hop, f"""
SELECT r_name, round(sum({REV}), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name""")
on_tables("rel_self_join_top1", R.self_join_top1, """
SELECT p.role AS prev_role, c.role AS next_role, count(*) AS n
FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
GROUP BY p.role, c.role ORDER BY n DESC, prev_role, next_role LIMIT 1""")
on_tables("rel_count_distinct", R.count_distinct, """
SELECT p_brand, count(DISTINCT o_custkey) AS n_customers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY p_brand""")
on_tables("rel_having_scalar", R.having_scalar, """
SELECT n_name, round(avg(c_acctbal), 4) AS avg_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name HAVING avg(c_acctbal) > (SELECT avg(c_acctbal) FROM customer)""")
on_tables("rel_reconcile", R.reconcile, """
SELECT o_orderkey, o_totalprice, round(sum(l_extendedprice), 2) AS line_total,
       round(o_totalprice - sum(l_extendedprice), 2) AS difference,
       abs(o_totalprice - sum(l_extendedprice)) < 0.005 AS matches
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice""")
on_tables("rel_range_closed", R.range_closed, """
SELECT count(*) AS n_orders FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'""")
on_tables("rel_top1_filter_across", R.top1_filter_across, f"""
SELECT p_type, round(sum({REV}), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE o_orderstatus = 'F' GROUP BY p_type ORDER BY sum({REV}) DESC, p_type LIMIT 1""")
on_tables("rel_union", R.union, "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
_SOLD = """SELECT l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{}'"""
on_tables("rel_except_intersect", R.except_intersect, f"""
SELECT l_partkey, 'both' AS kind FROM ({_SOLD.format('AMERICA')} INTERSECT {_SOLD.format('EUROPE')}) a
UNION ALL
SELECT l_partkey, 'only_a' AS kind FROM ({_SOLD.format('AMERICA')} EXCEPT {_SOLD.format('EUROPE')}) b""")
on_tables("rel_cte", R.cte, f"""
WITH rev AS (SELECT l_orderkey, sum({REV}) AS revenue FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority, count(*) AS n_orders, round(sum(revenue), 2) AS revenue
FROM rev JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
on_tables("rel_window", R.window, """
SELECT o_orderkey, o_custkey,
       CAST(row_number() OVER w AS INTEGER) AS order_seq,
       round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total,
       strftime(lag(o_orderdate) OVER w, '%Y-%m-%d') AS prev_orderdate
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
on_tables("rel_distinct_limit", R.distinct_limit,
          "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL ORDER BY p_brand LIMIT 10")
on_tables("rel_row_cap", R.row_cap,
          "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
