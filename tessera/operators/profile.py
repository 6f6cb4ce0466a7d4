"""PRO — profile a set of tables: counts, catalog, categorical values, keys,
references, schema cards.

Catalog metadata (one row per column) is built from ``df.schema`` on the
driver: it is bounded by the number of columns, not rows. Every data-dependent
number is a Spark aggregate, one pass per table for all of its columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date-like name hints and the categorical rule's limits.
DATE_HINTS = ("_on", "_at", "date", "time")
MAX_DISTINCT = 12
MAX_SAMPLES = 3
SMALL_TABLE = 6


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table; a bare ``count`` is answered from parquet footers."""
    return _union([df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
                   for name, df in sorted(tables.items())])


def catalog(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """table_name, ordinal, column_name, type, nullable, is_key — tables sorted by name."""
    keys = keys or {}
    rows = []
    for name in sorted(tables):
        for i, f in enumerate(tables[name].schema.fields, 1):
            rows.append((name, i, f.name, f.dataType.simpleString().upper(), f.nullable, f.name in keys.get(name, [])))
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type string, "
                                       "nullable boolean, is_key boolean")


def column_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Null count and exact distinct count of every column. Each table is unpivoted
    once to (column, 128-bit hash of the value): whole texts, pages and vectors are
    hashed where they are read, equal values are combined before the only shuffle,
    and no aggregate holds a column's values."""
    out = []
    for name in sorted(tables):
        df = tables[name]
        cells = F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.unhex(F.md5(F.col(f"`{f.name}`").cast("string"))).alias("h"))
                                   for i, f in enumerate(df.schema.fields, 1)]))
        per = (df.select(cells).groupBy("ordinal", "h").agg(F.count(F.lit(1)).alias("_f")).groupBy("ordinal").agg(
            F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col("_f"))), F.lit(0)).cast("long").alias("null_count"), F.count("h").alias("n_distinct")))
        names = F.create_map(*[x for i, f in enumerate(df.schema.fields, 1) for x in (F.lit(i), F.lit(f.name))])
        every = df.sparkSession.range(1, len(df.schema.fields) + 1).select(F.col("id").cast("int").alias("ordinal"))  # columns of an empty table too
        out.append(every.join(per, "ordinal", "left").select(
            F.lit(name).alias("table_name"), "ordinal", names[F.col("ordinal")].alias("column_name"),
            F.coalesce("null_count", F.lit(0)).alias("null_count"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct")))
    return _union(out)


def _text_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def categorical_samples(tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None,
                        max_distinct: int = MAX_DISTINCT, max_samples: int = MAX_SAMPLES,
                        small: int = SMALL_TABLE) -> DataFrame:
    """Text, non-key columns with ≤ ``max_distinct`` distinct non-null values and
    (fewer distinct values than rows, or a table of ≤ ``small`` rows): up to
    ``max_samples`` values, smallest first.

    Two passes: an ``approx_count_distinct`` gate over every text column (one
    aggregate per table, all in one job; one row per table is collected), then an exact
    unpivot + ``groupBy(column, value)`` over the survivors only. The gate keeps
    columns estimated under 2× the limit, far outside the estimator's error."""
    keys = keys or {}
    texts = {name: cols for name in sorted(tables) if (cols := _text_columns(tables[name], keys.get(name, [])))}
    gates = _union([tables[name].agg(F.count(F.lit(1)).alias("rows"), F.array(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.02) for c in cols]).alias("n"))
                    .select(F.lit(name).alias("name"), "rows", "n") for name, cols in texts.items()])
    parts = []
    for gate in sorted(gates.collect()):
        name, df, rows = gate["name"], tables[gate["name"]], gate["rows"]
        survivors = [c for c, n in zip(texts[name], gate["n"]) if n <= 2 * max_distinct]
        if not survivors:
            continue
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                     F.col(f"`{c}`").cast("string").alias("value"))
                                            for c in survivors]))).where(F.col("value").isNotNull())
        per = (long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_f"))
               .groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"),
                                           F.slice(F.sort_array(F.collect_list("value")), 1, max_samples).alias("_s")))
        # collect_list above holds at most 2×max_distinct values per column (gate), so it is bounded.
        keep = (F.col("n_distinct") <= max_distinct) & ((F.col("n_distinct") < F.lit(rows)) | F.lit(rows <= small))
        parts.append(per.where(keep).select(F.lit(name).alias("table_name"), "column_name", "n_distinct",
                                            F.array_join("_s", ", ").alias("samples")))
    return _union(parts)


def date_like_samples(tables: dict[str, DataFrame], hints=DATE_HINTS) -> DataFrame:
    """Columns whose name contains a date hint (a raw substring test): one
    sample (the smallest value, as date text) as a format hint. Typed date and
    timestamp columns are included: parquet keeps dates typed."""
    parts = []
    for name in sorted(tables):
        df = tables[name]
        dated = [f for f in df.schema.fields if any(h in f.name.lower() for h in hints)]
        if dated:
            typed = (T.DateType, T.TimestampType, T.TimestampNTZType)
            least = [F.struct(F.lit(f.name).alias("column_name"), (F.date_format(F.min(f"`{f.name}`"), "yyyy-MM-dd") if isinstance(f.dataType, typed)
                                                                  else F.min(F.col(f"`{f.name}`").cast("string"))).alias("sample")) for f in dated]
            parts.append(df.agg(F.array(*least).alias("each")).select(F.lit(name).alias("table_name"), F.inline("each")))
    return _union(parts)


def key_profile(tables: dict[str, DataFrame], candidates: dict[str, list[str]]) -> DataFrame:
    """Candidate keys tested on the data: rows, distinct key tuples, rows with a
    NULL key part, unique flag."""
    parts = []
    for name in sorted(candidates):
        cols = candidates[name]
        df = tables[name]
        anynull = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
        parts.append(df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(F.struct(*cols)).alias("n_distinct"),
            F.count_if(anynull).alias("n_null")).select(
            F.lit(name).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"),
            "n_rows", "n_distinct", "n_null",
            ((F.col("n_rows") == F.col("n_distinct")) & (F.col("n_null") == 0)).alias("is_unique")))
    return _union(parts)


def reference_check(tables: dict[str, DataFrame], edges: list[tuple[str, str, str, str]]) -> DataFrame:
    """Per declared reference (child.col → parent.col): orphan child rows,
    matched child rows, parents never referenced, and the largest fan-out.
    Children are counted per parent key first (one aggregate), so every
    following join is between key-distinct frames."""
    parts = []
    for child, ccol, parent, pcol in edges:
        per_key = tables[child].where(F.col(ccol).isNotNull()).groupBy(F.col(ccol).alias("_k")).agg(
            F.count(F.lit(1)).alias("_n"))
        parents = tables[parent].select(F.col(pcol).alias("_k")).distinct()
        j = per_key.join(parents.withColumn("_p", F.lit(True)), "_k", "full_outer")
        parts.append(j.agg(
            F.coalesce(F.sum(F.when(F.col("_p").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"),
            F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), F.col("_n"))), F.lit(0)).alias("matched"),
            F.count_if(F.col("_n").isNull()).alias("unused_parents"),
            F.coalesce(F.max(F.when(F.col("_p").isNotNull(), F.col("_n"))), F.lit(0)).alias("max_fanout"))
            .select(F.lit(child).alias("child"), F.lit(ccol).alias("child_column"), F.lit(parent).alias("parent"),
                    F.lit(pcol).alias("parent_column"), "orphans", "matched", "unused_parents", "max_fanout"))
    return _union(parts)


def schema_card(catalog_df: DataFrame, counts: DataFrame, samples: DataFrame, edges_df: DataFrame) -> DataFrame:
    """One text block per table: header with the row count, one line per column
    (type, ``PK``, ``NOT NULL``, ``-- e.g.`` samples), then reference lines.
    Lines are ordered by ordinal with ``sort_array`` over ``(ordinal, line)``;
    each list is bounded by the table's column count."""
    col_lines = (catalog_df.join(samples.select("table_name", "column_name", "samples"),
                                 ["table_name", "column_name"], "left")
                 .select("table_name", "ordinal", F.concat(
                     F.lit("  "), F.col("column_name"), F.lit(" "), F.col("type"),
                     F.when(F.col("is_key"), F.lit(" PK")).otherwise(F.lit("")),
                     F.when(~F.col("nullable"), F.lit(" NOT NULL")).otherwise(F.lit("")),
                     F.when(F.col("samples").isNotNull(), F.concat(F.lit(" -- e.g. "), F.col("samples"))).otherwise(F.lit(""))
                 ).alias("line")))
    ref_lines = edges_df.select(F.col("child").alias("table_name"), F.lit(100000).alias("ordinal"),
                                F.concat(F.lit("  "), F.col("child_column"), F.lit(" -> "), F.col("parent"),
                                         F.lit("."), F.col("parent_column")).alias("line"))
    lines = col_lines.unionByName(ref_lines)
    body = lines.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("ordinal", "line"))).alias("_l"))
    return (body.join(counts, "table_name")
            .select("table_name", F.concat(
                F.lit("TABLE "), F.col("table_name"), F.lit(" ("), F.col("n_rows").cast("string"), F.lit(" rows)\n"),
                F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("card")))


def compact_card(catalog_df: DataFrame, profile: DataFrame) -> DataFrame:
    """``table(col, col, …)`` per table: the columns that hold a value, in ordinal
    order, from the data's own profile."""
    held = profile.where(F.col("n_distinct") > 0).select("table_name", "column_name")
    catalog_df = catalog_df.join(held, ["table_name", "column_name"], "left_semi")
    g = catalog_df.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))).alias("_c"))
    return g.select("table_name", F.concat(F.col("table_name"), F.lit("("),
                                           F.array_join(F.transform("_c", lambda x: x["column_name"]), ", "),
                                           F.lit(")")).alias("card"))


def subset(catalog_df: DataFrame, proposals: DataFrame, counts: DataFrame) -> DataFrame:
    """Keep the named tables (case-insensitive); report proposals that do not
    exist; if none resolves, keep every table. Output: (name, status, n_rows), rows
    counted from the data, -1 for a table that does not exist."""
    names = catalog_df.select("table_name").distinct()
    props = proposals.select(F.col("name").alias("proposal"), F.lower("name").alias("_l"))
    hits = names.join(props, F.col("table_name") == F.col("_l"), "left_semi")
    n_hits = hits.agg(F.count(F.lit(1)).alias("_h"))
    kept_if_any = hits.crossJoin(F.broadcast(n_hits)).where(F.col("_h") > 0).drop("_h")
    kept_all = names.crossJoin(F.broadcast(n_hits)).where(F.col("_h") == 0).drop("_h")
    kept = kept_if_any.unionByName(kept_all).select(F.col("table_name").alias("name"), F.lit("kept").alias("status"))
    unknown = (props.join(names, F.col("_l") == F.col("table_name"), "left_anti")
               .select(F.col("proposal").alias("name"), F.lit("unknown").alias("status")))
    sized = kept.join(counts.withColumnRenamed("table_name", "name"), "name")
    return sized.unionByName(unknown.withColumn("n_rows", F.lit(-1).cast("long")))
