"""VAL keys: dictionary, closest values, empty-result diagnosis, reference lint."""

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import values as V
from ..operators.blocks import closest_by_blocks
from ..sources.tables import load_tables
from .keys_pro import CATALOG_SQL, KEYS
from .registry import register

# The text columns whose stored values form the dictionary.
DICT_COLUMNS = {"customer": ["c_mktsegment", "c_name"], "nation": ["n_name"], "orders": ["o_orderpriority", "o_orderstatus"],
                "part": ["p_brand", "p_type", "p_name"], "region": ["r_name"], "supplier": ["s_name"],
                "events": ["event_type"], "documents": ["lang", "source"], "conversations": ["role"]}


def lit(s):
    return "'" + s.replace("'", "''") + "'"


DICT_SQL = "dict AS (" + " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, {lit(c)} AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS freq "
    f"FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t in sorted(DICT_COLUMNS) for c in DICT_COLUMNS[t]) + ")"


def _dict(spark, d):
    return V.value_dictionary(load_tables(spark, d, register=False), DICT_COLUMNS)


@register("val_dictionary", f"WITH {DICT_SQL} SELECT * FROM dict")
def val_dictionary(spark, d):
    return _dict(spark, d)


# Needles: misspelt forms of stored values (case, separators, prefixes).
NEEDLES_SQL = """needles AS (
  SELECT DISTINCT concat('part.p_brand:', lower(replace(p_brand, '#', ' '))) AS needle_id, 'part' AS table_name,
         'p_brand' AS column_name, lower(replace(p_brand, '#', ' ')) AS literal FROM part
  UNION SELECT DISTINCT concat('orders.o_orderpriority:', lower(split_part(o_orderpriority, '-', 2))), 'orders',
         'o_orderpriority', lower(split_part(o_orderpriority, '-', 2)) FROM orders
  UNION SELECT DISTINCT concat('customer.c_mktsegment:', lower(c_mktsegment)), 'customer', 'c_mktsegment',
         lower(c_mktsegment) FROM customer)"""


def _needles(t):
    pb = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")))
    op = F.lower(F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(2)))
    cm = F.lower(F.col("c_mktsegment"))
    a = t["part"].select(F.concat(F.lit("part.p_brand:"), pb).alias("needle_id"), F.lit("part").alias("table_name"),
                         F.lit("p_brand").alias("column_name"), pb.alias("literal"))
    b = t["orders"].select(F.concat(F.lit("orders.o_orderpriority:"), op).alias("needle_id"), F.lit("orders").alias("table_name"),
                           F.lit("o_orderpriority").alias("column_name"), op.alias("literal"))
    c = t["customer"].select(F.concat(F.lit("customer.c_mktsegment:"), cm).alias("needle_id"),
                             F.lit("customer").alias("table_name"), F.lit("c_mktsegment").alias("column_name"), cm.alias("literal"))
    return a.unionByName(b).unionByName(c).distinct()


SIM_SQL = "CASE WHEN greatest(length(n.literal), length(d.value)) = 0 THEN 1.0 ELSE 1.0 - CAST(levenshtein(n.literal, d.value) AS DOUBLE) / greatest(length(n.literal), length(d.value)) END"


def closest_sql(needles_cte: str, k: int, cutoff: float) -> str:
    return f"""{needles_cte},
cand AS (SELECT n.needle_id, d.value, {SIM_SQL} AS score FROM needles n
         JOIN dict d ON d.table_name = n.table_name AND d.column_name = n.column_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY needle_id ORDER BY CASE WHEN score >= {cutoff} THEN 0 ELSE 1 END,
                                          CASE WHEN score >= {cutoff} THEN -score ELSE 0.0 END, value) AS rank FROM cand)"""


@register("val_closest", f"WITH {DICT_SQL}, {closest_sql(NEEDLES_SQL, V.MAX_VALUES, V.VALUE_CUTOFF)}\n"
          f"SELECT needle_id, CAST(rank AS INTEGER) AS rank, value, round(score, 4) AS score, score >= {V.VALUE_CUTOFF} AS close "
          f"FROM ranked WHERE rank <= {V.MAX_VALUES}")
def val_closest(spark, d):
    t = load_tables(spark, d, register=False)
    return V.closest(_needles(t), _dict(spark, d)).withColumn("rank", F.col("rank").cast("int"))


@register("val_closest_blocks")  # matching blocks are beyond SQL: compared with plain code in the tests
def val_closest_blocks(spark, d):
    t = load_tables(spark, d, register=False)
    return closest_by_blocks(_needles(t), _dict(spark, d))


PRED_SQL = """preds AS (
  SELECT DISTINCT concat('q:', lower(split_part(o_orderpriority, '-', 2))) AS query_id, 'orders' AS table_name,
         'o_orderpriority' AS column_name, lower(split_part(o_orderpriority, '-', 2)) AS literal FROM orders
  UNION SELECT DISTINCT concat('q:', o_orderpriority), 'orders', 'o_orderpriority', o_orderpriority FROM orders
  UNION SELECT DISTINCT concat('q:', lower(c_mktsegment)), NULL, 'c_mktsegment', lower(c_mktsegment) FROM customer
  UNION SELECT DISTINCT concat('q:', lower(r_name)), NULL, 'r_name', initcap_free FROM (SELECT r_name, lower(r_name) AS initcap_free FROM region) r)"""


def _predicates(t):
    op = F.lower(F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(2)))
    a = t["orders"].select(F.concat(F.lit("q:"), op).alias("query_id"), F.lit("orders").alias("table_name"),
                           F.lit("o_orderpriority").alias("column_name"), op.alias("literal"))
    b = t["orders"].select(F.concat(F.lit("q:"), F.col("o_orderpriority")).alias("query_id"), F.lit("orders").alias("table_name"),
                           F.lit("o_orderpriority").alias("column_name"), F.col("o_orderpriority").alias("literal"))
    cm = F.lower(F.col("c_mktsegment"))
    c = t["customer"].select(F.concat(F.lit("q:"), cm).alias("query_id"), F.lit(None).cast("string").alias("table_name"),
                             F.lit("c_mktsegment").alias("column_name"), cm.alias("literal"))
    rn = F.lower(F.col("r_name"))
    e = t["region"].select(F.concat(F.lit("q:"), rn).alias("query_id"), F.lit(None).cast("string").alias("table_name"),
                           F.lit("r_name").alias("column_name"), rn.alias("literal"))
    return a.unionByName(b).unionByName(c).unionByName(e).distinct()


@register("val_diagnose", f"""WITH {DICT_SQL}, {PRED_SQL},
holders AS (SELECT DISTINCT table_name, column_name FROM dict),
owner AS (SELECT p.query_id, p.column_name, p.literal, min(h.table_name) AS table_name
          FROM preds p JOIN holders h ON h.column_name = p.column_name AND (p.table_name IS NULL OR p.table_name = h.table_name)
          GROUP BY p.query_id, p.column_name, p.literal),
missing AS (SELECT * FROM owner o WHERE NOT EXISTS (SELECT 1 FROM dict d WHERE d.table_name = o.table_name
            AND d.column_name = o.column_name AND d.value = o.literal)),
{closest_sql("needles AS (SELECT concat(query_id, '|', table_name, '|', column_name, '|', literal) AS needle_id, table_name, column_name, literal FROM missing)", V.DIAGNOSE_SHOWN, V.VALUE_CUTOFF)},
listed AS (SELECT needle_id, string_agg(concat('''', value, ''''), ', ' ORDER BY rank) AS txt FROM ranked
           WHERE rank <= {V.DIAGNOSE_SHOWN} GROUP BY needle_id)
SELECT m.query_id, m.table_name, m.column_name, m.literal,
       concat(m.table_name, '.', m.column_name, ' = ''', m.literal, ''' matches nothing. Stored values include: ',
              coalesce(l.txt, '')) AS finding
FROM missing m LEFT JOIN listed l ON l.needle_id = concat(m.query_id, '|', m.table_name, '|', m.column_name, '|', m.literal)""")
def val_diagnose(spark, d):
    t = load_tables(spark, d, register=False)
    return V.diagnose(_predicates(t), _dict(spark, d))


REFS_SQL = """refs AS (
  SELECT p_partkey AS query_id, 'table' AS kind, 'p' AS qualifier, CASE WHEN p_size % 5 = 0 THEN 'parts' ELSE 'part' END AS name FROM part
  UNION ALL SELECT p_partkey, 'table', 'l', 'lineitem' FROM part WHERE p_size % 3 = 0
  UNION ALL SELECT p_partkey, 'column', 'p', CASE WHEN p_size % 7 = 0 THEN 'p_nme' ELSE 'p_name' END FROM part
  UNION ALL SELECT p_partkey, 'column', CASE WHEN p_size % 11 = 0 THEN 'x' ELSE 'p' END, 'p_brand' FROM part
  UNION ALL SELECT p_partkey, 'column', NULL, CASE WHEN p_size % 4 = 0 THEN 'l_quantiti' ELSE 'p_type' END FROM part
  UNION ALL SELECT p_partkey, 'column', NULL, 'total' FROM part
  UNION ALL SELECT p_partkey, 'output', NULL, 'total' FROM part
  UNION ALL SELECT p_partkey, 'local', NULL, 't' FROM part WHERE p_size % 13 = 0)"""


def refs_from_part(part):
    sz = F.col("p_size")
    s = lambda kind, q, name: F.struct(F.lit(kind).alias("kind"), q.alias("qualifier"), name.alias("name"))
    nul = F.lit(None).cast("string")
    arr = F.array(
        s("table", F.lit("p"), F.when(sz % 5 == 0, "parts").otherwise("part")),
        F.when(sz % 3 == 0, s("table", F.lit("l"), F.lit("lineitem"))),
        s("column", F.lit("p"), F.when(sz % 7 == 0, "p_nme").otherwise("p_name")),
        s("column", F.when(sz % 11 == 0, "x").otherwise("p"), F.lit("p_brand")),
        s("column", nul, F.when(sz % 4 == 0, "l_quantiti").otherwise("p_type")),
        s("column", nul, F.lit("total")),
        s("output", nul, F.lit("total")),
        F.when(sz % 13 == 0, s("local", nul, F.lit("t"))))
    return part.select(F.col("p_partkey").alias("query_id"), F.inline(F.array_compact(arr)))


def _catalog(spark, d):
    return P.catalog(spark, load_tables(spark, d, register=False), KEYS)


CHECK_SQL = f"""{CATALOG_SQL}, {REFS_SQL},
tabs AS (SELECT DISTINCT table_name FROM catalog),
scope AS (SELECT * FROM refs WHERE kind = 'table' AND name IN (SELECT table_name FROM tabs)),
handles AS (SELECT query_id, name AS handle, name AS h_table FROM scope
            UNION ALL SELECT query_id, qualifier, name FROM scope WHERE qualifier IS NOT NULL),
available AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT handle)), ', ') AS available FROM handles GROUP BY query_id),
resolved AS (SELECT c.query_id, c.qualifier, c.name, h.h_table FROM refs c
             LEFT JOIN handles h ON h.query_id = c.query_id AND h.handle = c.qualifier
             WHERE c.kind = 'column' AND c.qualifier IS NOT NULL),
problems AS (
  SELECT DISTINCT * FROM (
    SELECT query_id, 'unknown table' AS problem, name, '' AS detail FROM refs
    WHERE kind = 'table' AND name NOT IN (SELECT table_name FROM tabs)
    UNION ALL
    SELECT r.query_id, 'unknown qualifier', r.qualifier, coalesce(a.available, '') FROM resolved r
    LEFT JOIN available a ON a.query_id = r.query_id WHERE r.h_table IS NULL
    UNION ALL
    SELECT query_id, 'unknown column', name, h_table FROM resolved r WHERE h_table IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM catalog k WHERE k.table_name = r.h_table AND k.column_name = r.name)
    UNION ALL
    SELECT c.query_id, 'unknown column', c.name, 'in scope' FROM refs c
    WHERE c.kind = 'column' AND c.qualifier IS NULL
      AND c.query_id NOT IN (SELECT query_id FROM refs WHERE kind = 'local')
      AND NOT EXISTS (SELECT 1 FROM refs o WHERE o.kind = 'output' AND o.query_id = c.query_id AND o.name = c.name)
      AND NOT EXISTS (SELECT 1 FROM scope s JOIN catalog k ON k.table_name = s.name
                      WHERE s.query_id = c.query_id AND k.column_name = c.name)) x)"""


@register("val_check_refs", f"WITH {CHECK_SQL} SELECT * FROM problems")
def val_check_refs(spark, d):
    t = load_tables(spark, d, register=False)
    return V.check_refs(refs_from_part(t["part"]), _catalog(spark, d))


@register("val_closest_identifier", f"""WITH {CHECK_SQL},
cands AS (
  SELECT p.query_id, p.problem, p.name, p.detail, t.table_name AS cand FROM problems p, tabs t WHERE p.problem = 'unknown table'
  UNION ALL
  SELECT p.query_id, p.problem, p.name, p.detail, k.column_name FROM problems p JOIN catalog k ON k.table_name = p.detail
  WHERE p.problem = 'unknown column' AND p.detail <> 'in scope'
  UNION ALL
  SELECT p.query_id, p.problem, p.name, p.detail, k.column_name FROM problems p JOIN scope s ON s.query_id = p.query_id
  JOIN catalog k ON k.table_name = s.name WHERE p.problem = 'unknown column' AND p.detail = 'in scope'),
scored AS (SELECT *, CASE WHEN greatest(length(name), length(cand)) = 0 THEN 1.0
                          ELSE 1.0 - CAST(levenshtein(name, cand) AS DOUBLE) / greatest(length(name), length(cand)) END AS score
           FROM cands)
SELECT query_id, problem, name, detail, arg_min(cand, (-score, length(cand), cand)) AS suggestion, round(max(score), 4) AS score
FROM scored WHERE score >= {V.IDENT_CUTOFF} GROUP BY query_id, problem, name, detail""")
def val_closest_identifier(spark, d):
    t = load_tables(spark, d, register=False)
    refs = refs_from_part(t["part"])
    cat = _catalog(spark, d)
    return V.closest_identifier(V.check_refs(refs, cat), refs, cat)
