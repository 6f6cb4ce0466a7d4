"""PRO keys over all fourteen test tables."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import sketches as S
from ..session import ensure_checkpoint_dir
from ..sources.tables import TABLE_NAMES, load_tables
from .registry import register

# Column metadata of the test tables (as Spark names the types),
# declared keys and declared references.
COLUMNS = {
    "region": [("r_regionkey", "INT"), ("r_name", "STRING")],
    "nation": [("n_nationkey", "INT"), ("n_name", "STRING"), ("n_regionkey", "INT")],
    "customer": [("c_custkey", "BIGINT"), ("c_name", "STRING"), ("c_nationkey", "INT"), ("c_acctbal", "DOUBLE"),
                 ("c_mktsegment", "STRING")],
    "supplier": [("s_suppkey", "BIGINT"), ("s_name", "STRING"), ("s_nationkey", "INT"), ("s_acctbal", "DOUBLE")],
    "part": [("p_partkey", "BIGINT"), ("p_name", "STRING"), ("p_brand", "STRING"), ("p_type", "STRING"),
             ("p_size", "INT"), ("p_retailprice", "DOUBLE")],
    "orders": [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "STRING"),
               ("o_totalprice", "DOUBLE"), ("o_orderdate", "TIMESTAMP_NTZ"), ("o_orderpriority", "STRING")],
    "lineitem": [("l_orderkey", "BIGINT"), ("l_partkey", "BIGINT"), ("l_suppkey", "BIGINT"), ("l_linenumber", "INT"),
                 ("l_quantity", "DOUBLE"), ("l_extendedprice", "DOUBLE"), ("l_discount", "DOUBLE"), ("l_tax", "DOUBLE"),
                 ("l_returnflag", "STRING"), ("l_linestatus", "STRING"), ("l_shipdate", "TIMESTAMP_NTZ")],
    "events": [("event_id", "BIGINT"), ("ts", "TIMESTAMP_NTZ"), ("user_id", "BIGINT"), ("event_type", "STRING"),
               ("value", "DOUBLE"), ("props", "STRING")],
    "documents": [("doc_id", "BIGINT"), ("text", "STRING"), ("lang", "STRING"), ("source", "STRING"), ("n_chars", "BIGINT")],
    "embeddings": [("vec_id", "BIGINT"), ("embedding", "ARRAY<FLOAT>"), ("label", "INT")],
    "pages": [("page_id", "BIGINT"), ("url", "STRING"), ("html", "STRING")],
    "benchmark": [("item_id", "BIGINT"), ("text", "STRING")],
    "labels": [("doc_id", "BIGINT"), ("quality", "INT"), ("toxic", "INT")],
    "conversations": [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "STRING"), ("text", "STRING")],
}
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
        "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"],
        "labels": ["doc_id"], "benchmark": ["item_id"], "pages": ["page_id"], "embeddings": ["vec_id"],
        "conversations": ["conv_id", "turn"]}
KEY_CANDIDATES = dict(KEYS, lineitem=["l_orderkey", "l_linenumber"])
EDGES = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
         ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
         ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
         ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]
PROPOSALS = ["Customer", "ORDERS", "nations", "LineItem"]


def lit(s):
    return "'" + str(s).replace("'", "''") + "'"


def _t(spark, d):
    return load_tables(spark, d, register=False)


COUNTS_SQL = "counts AS (" + " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, count(*) AS n_rows FROM {t}" for t in sorted(COLUMNS)) + ")"


@register("pro_row_counts", f"WITH {COUNTS_SQL} SELECT * FROM counts")
def pro_row_counts(spark, d):
    return P.row_counts(_t(spark, d))


@register("pro_column_catalog", " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, {i} AS ordinal, {lit(c)} AS column_name, "
    f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count, count(DISTINCT {c}) AS n_distinct FROM {t}"
    for t in sorted(COLUMNS) for i, (c, _) in enumerate(COLUMNS[t], 1)))
def pro_column_catalog(spark, d):
    return P.column_profile(_t(spark, d))


CATEGORICAL_SQL = "cat AS (SELECT table_name, column_name, n_distinct, samples FROM (" + " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, {lit(c)} AS column_name, count(DISTINCT {c}) AS n_distinct, "
    f"(SELECT count(*) FROM {t}) AS n_rows, array_to_string(list_sort(list(DISTINCT {c}))[1:{P.MAX_SAMPLES}], ', ') AS samples FROM {t}"
    for t in sorted(COLUMNS) for c, ty in COLUMNS[t] if ty == "STRING" and c not in KEYS.get(t, [])) + \
    f") s WHERE n_distinct <= {P.MAX_DISTINCT} AND (n_distinct < n_rows OR n_rows <= {P.SMALL_TABLE}))"


@register("pro_categorical", f"WITH {CATEGORICAL_SQL} SELECT * FROM cat")
def pro_categorical(spark, d):
    return P.categorical_samples(_t(spark, d), KEYS)


@register("pro_date_like", " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, {lit(c)} AS column_name, "
    + (f"strftime(min({c}), '%Y-%m-%d')" if ty.startswith("TIMESTAMP") else f"min(CAST({c} AS VARCHAR))")
    + f" AS sample FROM {t}"
    for t in sorted(COLUMNS) for c, ty in COLUMNS[t] if any(h in c.lower() for h in P.DATE_HINTS)))
def pro_date_like(spark, d):
    return P.date_like_samples(_t(spark, d))


@register("pro_key_profile", " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, {lit(','.join(cs))} AS key_columns, count(*) AS n_rows, "
    f"count(DISTINCT ({', '.join(cs)})) AS n_distinct, "
    f"CAST(count(*) FILTER (WHERE {' OR '.join(c + ' IS NULL' for c in cs)}) AS BIGINT) AS n_null, "
    f"count(*) = count(DISTINCT ({', '.join(cs)})) AND count(*) FILTER (WHERE {' OR '.join(c + ' IS NULL' for c in cs)}) = 0 AS is_unique "
    f"FROM {t}" for t, cs in sorted(KEY_CANDIDATES.items())))
def pro_key_profile(spark, d):
    return P.key_profile(_t(spark, d), KEY_CANDIDATES)


@register("pro_reference_check", " UNION ALL ".join(f"""
SELECT {lit(ch)} AS child, {lit(cc)} AS child_column, {lit(pa)} AS parent, {lit(pc)} AS parent_column,
  CAST(coalesce(sum(n) FILTER (WHERE p IS NULL), 0) AS BIGINT) AS orphans,
  CAST(coalesce(sum(n) FILTER (WHERE p IS NOT NULL), 0) AS BIGINT) AS matched,
  count(*) FILTER (WHERE n IS NULL) AS unused_parents,
  CAST(coalesce(max(n) FILTER (WHERE p IS NOT NULL), 0) AS BIGINT) AS max_fanout
FROM (SELECT {cc} AS k, count(*) AS n FROM {ch} WHERE {cc} IS NOT NULL GROUP BY {cc}) c
FULL OUTER JOIN (SELECT DISTINCT {pc} AS k, true AS p FROM {pa}) q ON c.k = q.k""" for ch, cc, pa, pc in EDGES))
def pro_reference_check(spark, d):
    return P.reference_check(_t(spark, d), EDGES)


CATALOG_SQL = "catalog(table_name, ordinal, column_name, type, nullable, is_key) AS (VALUES " + ", ".join(
    f"({lit(t)}, {i}, {lit(c)}, {lit(ty)}, true, {'true' if c in KEYS.get(t, []) else 'false'})"
    for t in sorted(COLUMNS) for i, (c, ty) in enumerate(COLUMNS[t], 1)) + ")"
EDGES_SQL = "edges(child, child_column, parent, parent_column) AS (VALUES " + ", ".join(
    f"({lit(a)}, {lit(b)}, {lit(c)}, {lit(d)})" for a, b, c, d in EDGES) + ")"


def _catalog(spark, d):
    return P.catalog(spark, _t(spark, d), KEYS)


def _edges(spark):
    return spark.createDataFrame(EDGES, "child string, child_column string, parent string, parent_column string")


@register("pro_schema_card", f"""WITH {COUNTS_SQL}, {CATEGORICAL_SQL}, {CATALOG_SQL}, {EDGES_SQL},
lines AS (
  SELECT c.table_name, c.ordinal, concat('  ', c.column_name, ' ', c.type, CASE WHEN c.is_key THEN ' PK' ELSE '' END,
         CASE WHEN NOT c.nullable THEN ' NOT NULL' ELSE '' END,
         CASE WHEN s.samples IS NOT NULL THEN concat(' -- e.g. ', s.samples) ELSE '' END) AS line
  FROM catalog c LEFT JOIN cat s ON s.table_name = c.table_name AND s.column_name = c.column_name
  UNION ALL
  SELECT child, 100000, concat('  ', child_column, ' -> ', parent, '.', parent_column) FROM edges)
SELECT l.table_name, concat('TABLE ', l.table_name, ' (', CAST(k.n_rows AS VARCHAR), ' rows)', chr(10),
       string_agg(line, chr(10) ORDER BY ordinal, line)) AS card
FROM lines l JOIN counts k ON k.table_name = l.table_name GROUP BY l.table_name, k.n_rows""")
def pro_schema_card(spark, d):
    t = _t(spark, d)
    return P.schema_card(P.catalog(spark, t, KEYS), P.row_counts(t), P.categorical_samples(t, KEYS), _edges(spark))


HELD_SQL = "held AS (" + " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, {lit(c)} AS column_name FROM {t} HAVING count({c}) > 0" for t in sorted(COLUMNS) for c, _ in COLUMNS[t]) + ")"


@register("pro_compact_card", f"""WITH {CATALOG_SQL}, {HELD_SQL}
SELECT table_name, concat(table_name, '(', string_agg(column_name, ', ' ORDER BY ordinal), ')') AS card
FROM catalog JOIN held USING (table_name, column_name) GROUP BY table_name""")
def pro_compact_card(spark, d):
    return P.compact_card(_catalog(spark, d), P.column_profile(_t(spark, d)))


@register("pro_subset", f"""WITH {CATALOG_SQL}, {COUNTS_SQL},
props(name) AS (VALUES {', '.join('(' + lit(p) + ')' for p in PROPOSALS)}),
names AS (SELECT DISTINCT table_name FROM catalog),
hits AS (SELECT table_name FROM names WHERE table_name IN (SELECT lower(name) FROM props))
SELECT table_name AS name, 'kept' AS status, n_rows FROM hits JOIN counts USING (table_name)
UNION ALL SELECT table_name, 'kept', n_rows FROM names JOIN counts USING (table_name) WHERE (SELECT count(*) FROM hits) = 0
UNION ALL SELECT name, 'unknown', -1 FROM props WHERE lower(name) NOT IN (SELECT table_name FROM names)""")
def pro_subset(spark, d):
    props = spark.createDataFrame([(p,) for p in PROPOSALS], "name string")
    return P.subset(_catalog(spark, d), props, P.row_counts(_t(spark, d)))


@register("pro_column_sketches")  # estimates are beyond SQL: their bounds are tested
def pro_column_sketches(spark, d):
    """Sketches of every file of every table, united into one profile a table."""
    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    out = []
    for name in sorted(_t(spark, d)):
        path, own = f"{d}/{name}.parquet", f"{store}/{name}"
        S.refresh(spark, path, own)
        out.append(S.profile(spark, path, own).select(F.lit(name).alias("table_name"), "*"))
    return reduce(lambda a, b: a.unionByName(b), out)
