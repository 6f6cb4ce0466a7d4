"""VAL — stored values behind empty results, and reference linting.

Similarity is ``1 − levenshtein(a, b) / max(len a, len b)`` (JVM built-in, the
all-builtin default). Candidates are stored values of the needle's *column*, found by
the q-grams that they must share (``qgrams``); needles are a small table (literals of
a query log) broadcast behind a row bound, so the dictionary is never shuffled for the
join. Top-k per needle runs in two
stages (per needle and value-hash salt, then per needle), so a needle with
very many candidates is ranked by many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import qgrams

# The reference's cutoffs and list lengths.
MAX_VALUES = 12
VALUE_CUTOFF = 0.4
IDENT_CUTOFF = 0.6
DIAGNOSE_SHOWN = 5
SALT_BUCKETS = 64


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b).cast("double") / longest.cast("double"))


def value_dictionary(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Distinct non-null text values of many columns: (table, column, value, freq).
    Each table is unpivoted once (``inline`` of an array of structs) and counted
    by one grouped aggregate."""
    parts = []
    for t in sorted(columns):
        cols = columns[t]
        long = tables[t].select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])))
        parts.append(long.where(F.col("value").isNotNull()).groupBy("column_name", "value")
                     .agg(F.count(F.lit(1)).alias("freq")).select(F.lit(t).alias("table_name"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _top_k(cands: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    salt = F.pmod(F.xxhash64("value"), F.lit(SALT_BUCKETS))
    w1 = Window.partitionBy(key, "_salt").orderBy(*order)
    pre = cands.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(key).orderBy(*order)
    return pre.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k).drop("_salt", "_r1")


def closest(needles: DataFrame, dictionary: DataFrame, n: int = MAX_VALUES, cutoff: float = VALUE_CUTOFF) -> DataFrame:
    """Per needle: stored values with similarity ≥ ``cutoff`` first (best first),
    then the remaining values (smallest first), ``n`` in all.

    Only values that the cutoff allows by length and shared q-grams are scored. Of the
    remaining values a needle needs fewer than ``n``, and fewer than ``n`` are close if it
    needs any, so the ``2 n`` smallest of the column hold them all."""
    d = dictionary.select("table_name", "column_name", "value")
    score = similarity(F.col("literal"), F.col("value"))

    def best(scored: DataFrame) -> DataFrame:
        return _top_k(scored, "needle_id", [F.desc("score"), F.col("value")], n)

    near = best(qgrams.near(needles, d, score, cutoff, best, n))
    column = F.concat_ws(".", "table_name", "column_name")
    least = _top_k(d.withColumn("_column", column), "_column", [F.col("value")], 2 * n).drop("rank", "_column")
    rest = needles.join(least, ["table_name", "column_name"]).withColumn("score", score).where(F.col("score") < cutoff)
    both = near.select("needle_id", "value", "score", F.lit(True).alias("close")).unionByName(
        rest.select("needle_id", "value", "score", F.lit(False).alias("close")))
    # At most n close values and 2 n others of one needle.
    w = Window.partitionBy("needle_id").orderBy(F.desc("close"), F.desc(F.when(F.col("close"), F.col("score"))), "value")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(
        "needle_id", "rank", "value", F.round("score", 4).alias("score"), "close")


def diagnose(predicates: DataFrame, dictionary: DataFrame, shown: int = DIAGNOSE_SHOWN) -> DataFrame:
    """Equality predicates (query_id, table_name or NULL, column_name, literal):
    the first table (by name) that holds the column with values decides; if the
    literal is stored there, nothing is reported; otherwise the ``shown``
    nearest stored values are listed."""
    holders = dictionary.select("table_name", "column_name").distinct()
    p = predicates.withColumn("_pid", F.xxhash64("query_id", "column_name", "literal", F.coalesce("table_name", F.lit(""))))
    cand = p.alias("p").join(holders.alias("h"), (F.col("p.column_name") == F.col("h.column_name"))
                             & (F.col("p.table_name").isNull() | (F.col("p.table_name") == F.col("h.table_name"))))
    owner = cand.groupBy("_pid", "query_id", "p.column_name", "literal").agg(F.min("h.table_name").alias("table_name"))
    stored = dictionary.select("table_name", "column_name", F.col("value").alias("literal"))
    missing = owner.join(stored, ["table_name", "column_name", "literal"], "left_anti")
    needles = missing.select(F.col("_pid").alias("needle_id"), "table_name", "column_name", "literal")
    near = closest(needles, dictionary, shown)
    listed = near.groupBy("needle_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("_v"))  # at most `shown` per needle
    text = F.array_join(F.transform("_v", lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))), ", ")
    return (needles.join(listed, "needle_id", "left").join(missing.select(F.col("_pid").alias("needle_id"), "query_id"), "needle_id")
            .select("query_id", "table_name", "column_name", "literal",
                    F.concat(F.col("table_name"), F.lit("."), F.col("column_name"), F.lit(" = '"), F.col("literal"),
                             F.lit("' matches nothing. Stored values include: "), F.coalesce(text, F.lit(""))).alias("finding")))


def check_refs(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Lint references against the catalog.

    ``refs``: (query_id, kind, qualifier, name) with kind ∈ table (qualifier =
    alias or NULL), column (qualifier or NULL), local (a name the query defines,
    e.g. a CTE), output (an output alias). Problems: unknown table; unknown
    qualifier (with the available list); unknown column on its table; unknown
    unqualified column in scope — skipped when the query defines local names,
    and never raised for the query's own output aliases."""
    tabs = catalog.select(F.col("table_name").alias("t_name")).distinct()
    cols = catalog.select(F.col("table_name").alias("c_table"), F.col("column_name").alias("c_name"))
    t_refs = refs.where(F.col("kind") == "table")
    unknown_tables = (t_refs.join(tabs, F.col("name") == F.col("t_name"), "left_anti")
                      .select("query_id", F.lit("unknown table").alias("problem"), "name", F.lit("").alias("detail")))
    scope = t_refs.join(tabs, F.col("name") == F.col("t_name"), "left_semi")
    handles = (scope.select("query_id", F.col("name").alias("handle"), F.col("name").alias("h_table"))
               .unionByName(scope.where(F.col("qualifier").isNotNull())
                            .select("query_id", F.col("qualifier").alias("handle"), F.col("name").alias("h_table"))))
    available = handles.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("handle")), ", ").alias("available"))
    c_refs = refs.where(F.col("kind") == "column")
    qualified = c_refs.where(F.col("qualifier").isNotNull())
    resolved = qualified.join(handles, (qualified.query_id == handles.query_id) & (F.col("qualifier") == F.col("handle")), "left") \
        .select(qualified.query_id, "qualifier", "name", "h_table")
    unknown_qual = (resolved.where(F.col("h_table").isNull()).join(available, "query_id", "left")
                    .select("query_id", F.lit("unknown qualifier").alias("problem"), F.col("qualifier").alias("name"),
                            F.coalesce("available", F.lit("")).alias("detail")))
    bad_col = (resolved.where(F.col("h_table").isNotNull())
               .join(cols, (F.col("h_table") == F.col("c_table")) & (F.col("name") == F.col("c_name")), "left_anti")
               .select("query_id", F.lit("unknown column").alias("problem"), "name", F.col("h_table").alias("detail")))
    has_local = refs.where(F.col("kind") == "local").select("query_id").distinct()
    outputs = refs.where(F.col("kind") == "output").select("query_id", "name")
    unq = (c_refs.where(F.col("qualifier").isNull()).join(has_local, "query_id", "left_anti")
           .join(outputs, ["query_id", "name"], "left_anti"))
    in_scope_cols = scope.join(cols, F.col("name") == F.col("c_table")).select("query_id", F.col("c_name").alias("name"))
    bad_unq = (unq.join(in_scope_cols, ["query_id", "name"], "left_anti")
               .select("query_id", F.lit("unknown column").alias("problem"), "name", F.lit("in scope").alias("detail")))
    return unknown_tables.unionByName(unknown_qual).unionByName(bad_col).unionByName(bad_unq).distinct()


def closest_identifier(problems: DataFrame, refs: DataFrame, catalog: DataFrame,
                       cutoff: float = IDENT_CUTOFF) -> DataFrame:
    """Best "did you mean" (similarity ≥ ``cutoff``) for unknown tables and
    columns. A column on a known table draws from that table; an unqualified one
    from the single referenced table if there is one, else from all in scope."""
    tabs = catalog.select(F.col("table_name").alias("cand")).distinct()
    scope = refs.where(F.col("kind") == "table").join(tabs, F.col("name") == F.col("cand"), "left_semi") \
        .select("query_id", F.col("name").alias("s_table"))
    n_scope = scope.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    cols = catalog.select(F.col("table_name").alias("c_table"), F.col("column_name").alias("cand"))
    # Names within the cutoff are in the same length band (a band spans one factor of it) or the next.
    def band(c: str) -> Column:
        return F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / F.lit(math.log(1 / cutoff)) + F.lit(1e-9))

    unknown = problems.where(F.col("problem") == "unknown table").withColumn("_band", F.explode(F.sequence(band("name") - 1, band("name") + 1)))
    t_probs = unknown.join(tabs.withColumn("_band", band("cand")), "_band").drop("_band")
    c_on_table = (problems.where((F.col("problem") == "unknown column") & (F.col("detail") != "in scope"))
                  .join(cols, F.col("detail") == F.col("c_table")).drop("c_table"))
    unq = problems.where((F.col("problem") == "unknown column") & (F.col("detail") == "in scope"))
    c_in_scope = (unq.join(scope, "query_id").join(n_scope, "query_id")
                  .join(cols, F.col("s_table") == F.col("c_table")).drop("c_table", "s_table", "_n"))
    cands = t_probs.unionByName(c_on_table).unionByName(c_in_scope)
    scored = cands.withColumn("score", similarity(F.col("name"), F.col("cand"))).where(F.col("score") >= cutoff)
    best = scored.groupBy("query_id", "problem", "name", "detail").agg(
        F.min_by("cand", F.struct(-F.col("score"), F.length("cand"), F.col("cand"))).alias("suggestion"),
        F.round(F.max("score"), 4).alias("score"))
    return best
