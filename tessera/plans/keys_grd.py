"""GRD and LOG keys."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..functions.normalise import normalise, row_text
from ..functions.text import WS
from ..operators import compare as C
from ..operators import querylog as L
from ..operators import regrade as G
from ..operators import relational as R
from ..sources.tables import TABLE_NAMES, tables
from . import derived as D
from .derived_sql import ATTEMPTS, QUERY_LOG, QUESTIONS, REGRADE, RUNS, with_
from .joins import one_row
from .registry import register


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PAREN_GROUP = r"\([^()]*\)"


# ----------------------------------------------------------- normalisation, SQL side

def nsql(expr: str, kind: str) -> str:
    if kind == "int":
        return f"CAST({expr} AS VARCHAR)"
    if kind == "bool":
        return f"CASE WHEN {expr} THEN 'True' WHEN NOT {expr} THEN 'False' END"
    if kind == "double":
        x = f"CAST({expr} AS DOUBLE)"
        dec = f"CAST(CAST(round({x}, 6) AS DECIMAL(38,6)) AS VARCHAR)"
        small = f"regexp_replace(regexp_replace({dec}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
        return (f"CASE WHEN abs({x}) < 1e15 THEN {small} "
                f"WHEN abs({x}) < 9.2e18 THEN CAST(CAST(round({x}) AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END")
    return f"regexp_replace(CAST({expr} AS VARCHAR), {lit('^' + WS + '|' + WS + '$')}, '', 'g')"


def rowsql(cols) -> str:
    return "[" + ", ".join(nsql(c, k) for c, k in cols) + "]"


def rowtext_sql(cols) -> str:
    return "concat_ws(' | ', " + ", ".join(f"coalesce({nsql(c, k)}, '<NULL>')" for c, k in cols) + ")"


@register("grd_normalise_value", """
SELECT l_orderkey, l_linenumber, l_partkey,
  """ + nsql("l_extendedprice * (1 - l_discount)", "double") + """ AS n_revenue,
  """ + nsql("l_quantity", "double") + """ AS n_quantity,
  """ + nsql("concat(' ', l_returnflag, chr(9))", "text") + """ AS n_flag,
  """ + nsql("l_discount > 0.05", "bool") + """ AS n_discounted,
  """ + nsql("l_tax * 1e17", "double") + """ AS n_big
FROM lineitem""")
def grd_normalise_value(spark, d):
    li = tables(spark, d).lineitem
    from pyspark.sql import types as T
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        normalise(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")), T.DoubleType()).alias("n_revenue"),
        normalise(F.col("l_quantity"), T.DoubleType()).alias("n_quantity"),
        normalise(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit("\t")), T.StringType()).alias("n_flag"),
        normalise(F.col("l_discount") > 0.05, T.BooleanType()).alias("n_discounted"),
        normalise(F.col("l_tax") * F.lit(1e17), T.DoubleType()).alias("n_big"))


GOLD_SQL = "SELECT c_custkey, c_name, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name"
GOLD_COLS = [("c_custkey", "int"), ("c_name", "text"), ("n_orders", "int")]


@register("grd_normalise_rows", f"SELECT {rowtext_sql(GOLD_COLS)} AS row_text FROM ({GOLD_SQL}) g")
def grd_normalise_rows(spark, d):
    from ..functions.normalise import normalise_rows
    return normalise_rows(R.join_count(tables(spark, d))).select(row_text(F.col("row")).alias("row_text"))


def _pairs(t):
    """Result pairs: the reference query against rewrites and broken variants."""
    gold = R.join_count(t)
    hi = one_row(gold.agg(F.max("c_custkey").alias("_hi")))
    lo = one_row(gold.agg(F.min("c_custkey").alias("_lo")))
    rewrite = (t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
               .groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("n_orders"))
               .where(F.col("n_orders") > 0))
    removed = gold.crossJoin(hi).where(F.col("c_custkey") != F.col("_hi")).drop("_hi")
    doubled = gold.unionByName(gold.crossJoin(lo).where(F.col("c_custkey") == F.col("_lo")).drop("_lo"))
    swapped = gold.select("n_orders", "c_name", "c_custkey")
    wrong_agg = (t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
                 .groupBy("c_custkey", "c_name").agg(F.round(F.sum("o_totalprice"), 2).alias("n_orders")))
    as_double = gold.withColumn("n_orders", F.col("n_orders").cast("double"))
    padded = gold.withColumn("c_name", F.concat(F.lit("  "), F.col("c_name"), F.lit("\t")))
    extra = gold.withColumn("n_twice", F.col("n_orders") * 2)
    return gold, [("rewrite", rewrite), ("row_removed", removed), ("row_doubled", doubled),
                  ("columns_swapped", swapped), ("wrong_aggregate", wrong_agg), ("int_vs_double", as_double),
                  ("padded_text", padded), ("extra_column", extra)]


PAIR_SQL = {
    "rewrite": ("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey "
                "GROUP BY c_custkey, c_name HAVING count(o_orderkey) > 0", GOLD_COLS),
    "row_removed": ("SELECT * FROM gold WHERE c_custkey <> (SELECT max(c_custkey) FROM gold)", GOLD_COLS),
    "row_doubled": ("SELECT * FROM gold UNION ALL SELECT * FROM gold WHERE c_custkey = (SELECT min(c_custkey) FROM gold)", GOLD_COLS),
    "columns_swapped": ("SELECT n_orders, c_name, c_custkey FROM gold", [("n_orders", "int"), ("c_name", "text"), ("c_custkey", "int")]),
    "wrong_aggregate": ("SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey "
                        "GROUP BY c_custkey, c_name", [("c_custkey", "int"), ("c_name", "text"), ("n_orders", "double")]),
    "int_vs_double": ("SELECT c_custkey, c_name, CAST(n_orders AS DOUBLE) AS n_orders FROM gold",
                      [("c_custkey", "int"), ("c_name", "text"), ("n_orders", "double")]),
    "padded_text": ("SELECT c_custkey, concat('  ', c_name, chr(9)) AS c_name, n_orders FROM gold", GOLD_COLS),
    "extra_column": ("SELECT *, n_orders * 2 AS n_twice FROM gold", GOLD_COLS + [("n_twice", "int")]),
}


def verdict_sql(label: str, pred_sql: str, pred_cols, gold_cols) -> str:
    return f"""SELECT {lit(label)} AS pair, count(*) FILTER (WHERE pn <> gn) = 0 AS correct,
  CASE WHEN count(*) FILTER (WHERE pn <> gn) = 0 THEN 'match'
       WHEN sum(pn) <> sum(gn) THEN concat('row count differs: got ', CAST(sum(pn) AS VARCHAR), ', expected ', CAST(sum(gn) AS VARCHAR))
       ELSE 'same row count, different values' END AS reason,
  CAST(sum(pn) AS BIGINT) AS pred_rows, CAST(sum(gn) AS BIGINT) AS gold_rows
FROM (SELECT r, sum(p) AS pn, sum(g) AS gn FROM (
        SELECT {rowsql(pred_cols)} AS r, 1 AS p, 0 AS g FROM ({pred_sql}) x
        UNION ALL SELECT {rowsql(gold_cols)}, 0, 1 FROM gold) u GROUP BY r) s"""


@register("grd_compare", f"WITH gold AS ({GOLD_SQL})\n" + "\nUNION ALL\n".join(
    verdict_sql(k, s, cols, GOLD_COLS) for k, (s, cols) in PAIR_SQL.items()))
def grd_compare(spark, d):
    gold, pairs = _pairs(tables(spark, d))
    out = None
    for label, pred in pairs:
        v = C.compare(pred, gold, label=label)
        out = v if out is None else out.unionByName(v)
    return out


DIFF_PRED = ("SELECT * FROM gold WHERE c_custkey <> (SELECT max(c_custkey) FROM gold) "
             "UNION ALL SELECT * FROM gold WHERE c_custkey = (SELECT min(c_custkey) FROM gold) "
             "UNION ALL SELECT c_custkey, c_name, n_orders + 1 FROM gold WHERE c_custkey = (SELECT min(c_custkey) FROM gold) + 1")


@register("grd_diff_rows", f"""WITH gold AS ({GOLD_SQL}),
u AS (SELECT {rowtext_sql(GOLD_COLS)} AS t, 1 AS p, 0 AS g FROM ({DIFF_PRED}) x
      UNION ALL SELECT {rowtext_sql(GOLD_COLS)}, 0, 1 FROM gold),
s AS (SELECT t, CAST(sum(p) AS BIGINT) AS pred_n, CAST(sum(g) AS BIGINT) AS gold_n FROM u GROUP BY t)
SELECT t AS row_text, pred_n, gold_n,
       CASE WHEN pred_n = 0 THEN 'missing' WHEN gold_n = 0 THEN 'extra' ELSE 'multiplicity' END AS kind
FROM s WHERE pred_n <> gold_n""")
def grd_diff_rows(spark, d):
    t = tables(spark, d)
    gold = R.join_count(t)
    hi = one_row(gold.agg(F.max("c_custkey").alias("_hi")))
    lo = one_row(gold.agg(F.min("c_custkey").alias("_lo")))
    g2 = gold.crossJoin(hi).crossJoin(lo)
    pred = (g2.where(F.col("c_custkey") != F.col("_hi"))
            .unionByName(g2.where(F.col("c_custkey") == F.col("_lo")))
            .unionByName(g2.where(F.col("c_custkey") == F.col("_lo") + 1).withColumn("n_orders", F.col("n_orders") + 1))
            .drop("_hi", "_lo"))
    return C.diff_rows(pred, gold)


@register("grd_wants_order", with_(QUERY_LOG) + """
SELECT query_id, contains(lower(sql), 'order by') AS wants_order FROM query_log""")
def grd_wants_order(spark, d):
    log = D.query_log(spark, tables(spark, d).part)
    return log.select("query_id", C.wants_order(F.col("sql")).alias("wants_order"))


@register("grd_fingerprint", """
SELECT p_type, count(*) AS n_rows,
       CAST(sum(CAST(('0x' || substr(md5(concat(coalesce(concat(CAST(length(p_brand) AS VARCHAR), ':', p_brand), '-'), coalesce(concat(CAST(length(CAST(p_size AS VARCHAR)) AS VARCHAR), ':', CAST(p_size AS VARCHAR)), '-'))), 1, 15)) AS BIGINT)) AS VARCHAR) AS fp1,
       CAST(sum(CAST(('0x' || substr(md5(concat(coalesce(concat(CAST(length(p_brand) AS VARCHAR), ':', p_brand), '-'), coalesce(concat(CAST(length(CAST(p_size AS VARCHAR)) AS VARCHAR), ':', CAST(p_size AS VARCHAR)), '-'))), 16, 15)) AS BIGINT)) AS VARCHAR) AS fp2
FROM part GROUP BY p_type""")
def grd_fingerprint(spark, d):
    return C.fingerprint(tables(spark, d).part, ["p_type"], ["p_brand", "p_size"])


@register("grd_is_empty", with_(ATTEMPTS) + """
SELECT arm, question_id, attempt_no, ok, k % 5 AS row_count, ok AND k % 5 = 0 AS is_empty FROM attempts""")
def grd_is_empty(spark, d):
    a = D.attempts(tables(spark, d).events).select("arm", "question_id", "attempt_no", "ok",
                                                   (F.col("k") % 5).alias("row_count"))
    return C.is_empty(a)


SUITE_JOBS = 8

# Suite pairs in Spark SQL over the registered views: (label, predicted, reference).
SUITE = [
    ("match_rewrite", "SELECT count(*) FROM customer", "SELECT count(c_custkey) AS n FROM customer"),
    ("match_float", "SELECT sum(o_totalprice) / count(*) FROM orders", "SELECT avg(o_totalprice) FROM orders"),
    ("no_query", "  ", "SELECT 1"),
    ("missing_column", "SELECT c_nope FROM customer", "SELECT c_name FROM customer"),
    ("reference_failed", "SELECT 1", "SELECT nope FROM nowhere"),
    ("row_count", "SELECT c_name FROM customer WHERE c_acctbal > 0", "SELECT c_name FROM customer"),
    ("values", "SELECT max(c_acctbal) FROM customer", "SELECT min(c_acctbal) FROM customer"),
    ("ordered_wrong", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC",
     "SELECT c_custkey FROM customer ORDER BY c_custkey"),
    ("ordered_right", "SELECT c_custkey FROM customer ORDER BY c_custkey",
     "SELECT c_custkey FROM customer ORDER BY c_custkey"),
]


def grade_suite(spark, pairs, at_once=SUITE_JOBS):
    """Grade a table of (label, predicted SQL, reference SQL): a bounded number of pairs at
    a time, each a few Spark jobs in a fair pool of its own, of which only the one-row
    verdict is collected. A query text that several pairs hold is run once. What goes
    wrong while a pair is graded is charged to that pair."""
    runs = C.QueryRuns(spark)

    def grade(numbered):
        n, (label, pred, gold) = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"grade-{n % at_once}")
        try:
            return label, *C.execution_accuracy(spark, pred, gold, runs=runs)
        except Exception as e:
            return label, False, f"query failed: {C.first_line(e)}", None, None
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(grade, enumerate(pairs)))
    graded = spark.createDataFrame(rows, "pair string, correct boolean, reason string, pred_rows long, gold_rows long")
    # The database's own message follows the colon of a failure.
    counts = {c: F.coalesce(c, F.lit(-1)) for c in ("pred_rows", "gold_rows")}  # -1: not run
    return graded.withColumns(counts).withColumn("reason", F.regexp_replace("reason", r"(?i)^((?:reference )?query failed):.*$", "$1"))


FLOAT_SQL = """SELECT 'match_float' AS pair, ok AS correct, CASE WHEN ok THEN 'match' ELSE 'same row count, different values' END AS reason,
       CAST(1 AS BIGINT) AS pred_rows, CAST(1 AS BIGINT) AS gold_rows
FROM (SELECT round(sum(o_totalprice) / count(*), 6) = round(avg(o_totalprice), 6) AS ok FROM orders)"""
SUITE_SQL = FLOAT_SQL + """
UNION ALL SELECT 'match_rewrite', true, 'match', 1, 1
UNION ALL SELECT 'no_query', false, 'no query produced', -1, -1
UNION ALL SELECT 'missing_column', false, 'query failed', -1, -1
UNION ALL SELECT 'reference_failed', false, 'REFERENCE QUERY FAILED', -1, -1
UNION ALL SELECT 'row_count', p = g, CASE WHEN p = g THEN 'match' ELSE concat('row count differs: got ', CAST(p AS VARCHAR), ', expected ', CAST(g AS VARCHAR)) END, p, g
  FROM (SELECT count_if(c_acctbal > 0) AS p, count(*) AS g FROM customer)
UNION ALL SELECT 'values', lo = hi, CASE WHEN lo = hi THEN 'match' ELSE 'same row count, different values' END, 1, 1
  FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
UNION ALL SELECT 'ordered_wrong', false, 'same row count, different values', count(*), count(*) FROM customer
UNION ALL SELECT 'ordered_right', true, 'match', count(*), count(*) FROM customer"""


@register("grd_execution", FLOAT_SQL)
def grd_execution(spark, d):
    from ..sources.tables import load_tables
    load_tables(spark, d)
    return grade_suite(spark, SUITE[1:2])


@register("grd_suite", SUITE_SQL)
def grd_suite(spark, d):
    from ..sources.tables import load_tables
    load_tables(spark, d)
    return grade_suite(spark, SUITE)


def _graded(spark, d):
    t = tables(spark, d)
    return D.regrade_input(D.runs(t.events), D.questions(t.events, t.documents))


TALLY_SQL = """tallies AS (
  SELECT arm, count(*) AS rows, count_if(NOT skipped AND correct) AS final_was, count_if(NOT skipped AND final_now) AS final_now,
         count_if(NOT skipped AND NOT ungradable AND draft_correct) AS draft_was,
         count_if(NOT skipped AND NOT ungradable AND draft_now) AS draft_now,
         count_if(NOT skipped AND ungradable) AS ungradable, count_if(skipped) AS skipped
  FROM graded GROUP BY arm)"""


@register("grd_regrade", with_(RUNS, QUESTIONS, REGRADE, TALLY_SQL) + "SELECT * FROM tallies")
def grd_regrade(spark, d):
    return G.regrade(_graded(spark, d))


@register("grd_flips", with_(RUNS, QUESTIONS, REGRADE) + """
SELECT arm, question_id, 'final' AS grade, CASE WHEN final_now THEN 'gained' ELSE 'lost' END AS direction
FROM graded WHERE NOT skipped AND correct <> final_now
UNION ALL
SELECT arm, question_id, 'draft', CASE WHEN draft_now THEN 'gained' ELSE 'lost' END
FROM graded WHERE NOT skipped AND NOT ungradable AND draft_correct <> draft_now""")
def grd_flips(spark, d):
    return G.flips(_graded(spark, d))


@register("grd_regrade_report", with_(RUNS, QUESTIONS, REGRADE, TALLY_SQL) + """
SELECT arm,
  round(100.0 * final_was / nullif(rows - skipped, 0), 4) AS final_was_pct,
  round(100.0 * final_now / nullif(rows - skipped, 0), 4) AS final_now_pct,
  round(100.0 * draft_was / nullif(rows - skipped - ungradable, 0), 4) AS draft_was_pct,
  round(100.0 * draft_now / nullif(rows - skipped - ungradable, 0), 4) AS draft_now_pct
FROM tallies""")
def grd_regrade_report(spark, d):
    return G.regrade_report(G.regrade(_graded(spark, d)))


# ---------------------------------------------------------------- LOG

def rc(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(p)}))"


CLEAN = f"upper(regexp_replace(sql, {lit(L.LITERAL_OR_COMMENT)}, ' ', 'g'))"


def _outer_sql(x: str) -> str:
    for _ in range(16):  # far above the templates' depth; the Spark side has no bound
        x = f"regexp_replace({x}, {lit(PAREN_GROUP)}, ' ', 'g')"
    return x


KNOWN = "[" + ", ".join(lit(t.upper()) for t in TABLE_NAMES) + "]"
FEATURES_SQL = f"""feat AS (
  SELECT query_id, sql, u,
    {rc('u', L.P_JOIN)} AS n_joins, {rc('u', L.P_OUTER)} > 0 AS has_outer,
    {rc('u', L.P_SUBQUERY)} AS n_subqueries, {rc('u', L.P_EXISTS)} > 0 AS has_exists,
    {rc('r', L.P_GROUP)} > 0 AS has_group_by, {rc('r', L.P_HAVING)} > 0 AS has_having,
    {rc('u', L.P_WINDOW)} > 0 AS has_window, {rc('u', L.P_AGG)} AS n_aggregates,
    {rc('u', L.P_DIV)} > 0 AS has_division,
    {rc(f"regexp_replace(u, {lit(L.P_NOT_MUL)}, ' ', 'g')", L.P_MUL)} > 0 AS has_multiplication,
    {rc('u', L.P_CASE)} > 0 AS has_case,
    len(regexp_extract_all(r, {lit(L.P_TABLE)}, 1)) <> len(list_distinct(regexp_extract_all(r, {lit(L.P_TABLE)}, 1))) AS has_self_join,
    len(list_filter(list_distinct(regexp_extract_all(u, {lit(L.P_TABLE)}, 1)), lambda x: NOT list_contains({KNOWN}, x))) > 0 AS has_mismatch
  FROM (SELECT query_id, sql, u, {_outer_sql('u')} AS r FROM (SELECT query_id, sql, {CLEAN} AS u FROM query_log) a) b)"""


@register("log_features", with_(QUERY_LOG, FEATURES_SQL) + """
SELECT query_id, sql, n_joins, has_outer, n_subqueries, has_exists, has_group_by, has_having, has_window,
       n_aggregates, has_division, has_multiplication, has_case, has_self_join, has_mismatch FROM feat""")
def log_features(spark, d):
    return L.features(D.query_log(spark, tables(spark, d).part), list(TABLE_NAMES)).drop("_u")


W_ = L.WEIGHTS
SCORE_SQL = (f"n_joins * {W_['join']} + CASE WHEN has_outer THEN {W_['outer']} ELSE 0 END + n_subqueries * {W_['subquery']}"
             f" + CASE WHEN has_exists THEN {W_['exists']} ELSE 0 END + CASE WHEN has_group_by THEN {W_['group']} ELSE 0 END"
             f" + CASE WHEN has_having THEN {W_['having']} ELSE 0 END + CASE WHEN has_window THEN {W_['window']} ELSE 0 END"
             f" + CASE WHEN n_aggregates > 0 THEN {W_['aggregate']} ELSE 0 END + CASE WHEN has_division THEN {W_['division']} ELSE 0 END"
             f" + CASE WHEN has_multiplication THEN {W_['multiplication']} ELSE 0 END + CASE WHEN has_case THEN {W_['case']} ELSE 0 END"
             f" + CASE WHEN has_self_join THEN {W_['self_join']} ELSE 0 END + CASE WHEN has_mismatch THEN {W_['mismatch']} ELSE 0 END")
UNREADABLE_SQL = f"(trim(u) = '' OR NOT regexp_matches(u, {lit(L.P_READ)}))"
SIGNALS_SQL = """concat_ws(', ',
  CASE WHEN n_joins > 0 THEN concat(CAST(n_joins AS VARCHAR), ' join(s)') END, CASE WHEN has_outer THEN 'outer join' END,
  CASE WHEN n_subqueries > 0 THEN concat(CAST(n_subqueries AS VARCHAR), ' subquery(s)') END, CASE WHEN has_exists THEN 'EXISTS' END,
  CASE WHEN has_group_by THEN 'GROUP BY' END, CASE WHEN has_having THEN 'HAVING' END, CASE WHEN has_window THEN 'window function' END,
  CASE WHEN n_aggregates > 0 THEN concat(CAST(n_aggregates AS VARCHAR), ' aggregate(s)') END, CASE WHEN has_division THEN 'division' END,
  CASE WHEN has_multiplication THEN 'multiplication' END, CASE WHEN has_case THEN 'CASE' END,
  CASE WHEN has_self_join THEN 'self-join' END, CASE WHEN has_mismatch THEN 'schema mismatch' END)"""


@register("log_risk_tier", with_(QUERY_LOG, FEATURES_SQL) + f"""
SELECT query_id, score, CASE WHEN score >= {L.VERIFY_THRESHOLD} THEN 'verify' ELSE 'trust' END AS tier, signals FROM (
  SELECT query_id, CASE WHEN {UNREADABLE_SQL} THEN {L.UNREADABLE_SCORE} ELSE {SCORE_SQL} END AS score,
         CASE WHEN {UNREADABLE_SQL} THEN 'not a read query' ELSE {SIGNALS_SQL} END AS signals FROM feat) s""")
def log_risk_tier(spark, d):
    return L.risk_tier(D.query_log(spark, tables(spark, d).part), list(TABLE_NAMES))


@register("log_screen", with_(QUERY_LOG) + f"""
SELECT query_id, CASE WHEN sql IS NULL OR trim(u) = '' THEN 'empty'
                      WHEN regexp_matches(u, {lit(L.P_MORE_STATEMENTS)}) THEN 'several statements'
                      WHEN NOT regexp_matches(u, {lit(L.P_READ)}) THEN 'not a read'
                      WHEN regexp_matches(u, {lit(L.P_FORBIDDEN_VERB)}) THEN 'forbidden verb'
                      WHEN regexp_matches(u, {lit(L.P_FORBIDDEN_FN)}) THEN 'forbidden function'
                      ELSE 'ok' END AS verdict
FROM (SELECT query_id, sql, {CLEAN} AS u FROM query_log) a""")
def log_screen(spark, d):
    return L.screen(D.query_log(spark, tables(spark, d).part))
