"""Column profiles of growing tables: sketches are kept per file and united.

The exact profile (``profile.column_profile``) reads a whole table each time. Here each
file is read once: its rows, nulls, least and greatest values, an HLL sketch of distinct
values and a KLL sketch of quantiles of each column go to a store, and a profile unites
the sketches of the files that the table holds now. A refresh reads only files that the
store does not know by name, time and size, so the work on an appended table is that of
the new files, and files that were removed no longer count.

The store is a version log (``sources.versions``): a refresh adds one folder. Rows of one
file are the same whoever wrote them and are united once, so two refreshes at a time do no
harm. With ``LG_K`` 12 the standard error of a distinct count is about 1.6 %; quantiles
are within about 1.7 % of the rank (KLL with k 200).

Defined cases: nulls are counted and not sketched; NaN is left out of quantiles; a column
without values has 0 distinct values and null quantiles; a table without files, or a store
without rows, gives no rows. A column that some files lack counts its rows there as nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.versions import VersionLog

LG_K = 12
QUANTILES = (0.25, 0.5, 0.75)
FILE = ["file", "modified", "size"]
_STORED = ("file string, modified timestamp, size long, column_name string, numeric boolean, n_rows long, null_count long, "
           "least string, greatest string, distinct_sketch binary, quantile_sketch binary")


def _one_slash(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def files(spark: SparkSession, path: str) -> DataFrame:
    """``file, modified, size`` of a table's Parquet files; their content is not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return listed.select(_one_slash(F.col("path")).alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def _cells(field: T.StructField) -> tuple[list[Column], Column]:
    """A column's aggregates, and the struct that names them."""
    c, name = F.col(f"`{field.name}`"), field.name
    numeric = isinstance(field.dataType, T.NumericType)
    plain = field.dataType if isinstance(field.dataType, (T.IntegerType, T.LongType, T.StringType)) else T.StringType()
    number = c.cast("double") if numeric else F.lit(None).cast("double")
    ordered = isinstance(field.dataType, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))
    aggs = [F.count_if(c.isNull()).alias(f"nulls {name}"), F.hll_sketch_agg(c.cast(plain), LG_K).alias(f"hll {name}")]
    aggs += [F.kll_sketch_agg_double(F.when(~F.isnan(number), number)).alias(f"kll {name}")] if numeric else []
    aggs += [f(c).cast("string").alias(f"{f.__name__} {name}") for f in (F.min, F.max)] if ordered else []
    end = {f: F.col(f"`{f} {name}`") if ordered else F.lit(None).cast("string") for f in ("min", "max")}
    sketch = F.col(f"`kll {name}`") if numeric else F.lit(None).cast("binary")
    return aggs, F.struct(F.lit(name).alias("column_name"), F.lit(numeric).alias("numeric"), F.col(f"`nulls {name}`").alias("null_count"),
                          end["min"].alias("least"), end["max"].alias("greatest"), F.col(f"`hll {name}`").alias("distinct_sketch"), sketch.alias("quantile_sketch"))


def sketch_files(df: DataFrame) -> DataFrame:
    """``file, column_name, ...`` sketches of a Parquet read, by file: one partial aggregate,
    a row per file is what is shuffled."""
    cells = [_cells(f) for f in df.schema.fields]
    per = df.withColumn("_metadata_path", F.col("_metadata.file_path")).groupBy("_metadata_path").agg(
        F.count(F.lit(1)).alias("_n_rows"), *[a for aggs, _ in cells for a in aggs])
    name = _one_slash(F.url_decode(F.replace(F.col("_metadata_path"), F.lit("+"), F.lit("%2B"))))
    return per.select(name.alias("file"), F.col("_n_rows").alias("n_rows"), F.inline(F.array(*[s for _, s in cells])))


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The store's rows, those of one file and column once."""
    log = VersionLog(spark, store)
    head = log.head()
    if not head.number:
        return spark.createDataFrame([], _STORED)
    rows = spark.read.schema(_STORED).parquet(*[f"{log.path}/{x}" for x in head.state])
    rest = [f.name for f in rows.schema.fields if f.name not in FILE + ["column_name"]]
    return rows.groupBy(*FILE, "column_name").agg(F.any_value(F.struct(*rest)).alias("s")).select(*FILE, "column_name", "s.*")


def refresh(spark: SparkSession, path: str, store: str) -> int:
    """Sketch the files of the table at ``path`` that ``store`` does not know, and return
    how many. Only their names come to the driver, as a read takes them."""
    now = files(spark, path)
    new = now.join(stored(spark, store).select(*FILE).distinct(), FILE, "left_anti").select("file").toPandas()["file"].tolist()
    if not new:
        return 0
    made = sketch_files(spark.read.option("mergeSchema", "true").parquet(*new)).join(now, "file")
    log = VersionLog(spark, store)
    folder = log.folder()
    names = [f.name for f in spark.createDataFrame([], _STORED).schema.fields]
    made.select(*names).write.parquet(f"{log.path}/{folder}")
    log.change(lambda head: ([*(head.state or []), folder], [*(head.state or []), folder]), "sketch")
    return len(new)


def profile(spark: SparkSession, path: str, store: str) -> DataFrame:
    """``column_name, n_rows, null_count, least, greatest, n_distinct, quantiles`` of the
    table's files that the store knows. Numbers are compared as such by their quantiles;
    ``least`` and ``greatest`` are the ends of numeric columns as numbers, of others as text."""
    held = stored(spark, store).join(files(spark, path), FILE, "left_semi")
    total = held.groupBy(*FILE).agg(F.max("n_rows").alias("n")).agg(F.sum("n").alias("total"))

    def end(pick, c: str) -> Column:
        as_number = pick(F.struct(F.col(c).try_cast("double").alias("number"), F.col(c).alias("text")))["text"]
        return F.when(F.any_value("numeric"), as_number).otherwise(pick(F.col(c)))

    known = F.col("least").isNotNull()
    per = held.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_seen"), F.sum("null_count").alias("nulls"),
        end(lambda c: F.min(F.when(known, c)), "least").alias("least"), end(lambda c: F.max(F.when(known, c)), "greatest").alias("greatest"),
        F.hll_union_agg("distinct_sketch", F.lit(True)).alias("h"), F.kll_merge_agg_double("quantile_sketch").alias("k"), F.any_value("numeric").alias("numeric"))
    at = F.array(*[F.lit(q) for q in QUANTILES])
    some = F.col("numeric") & (F.kll_sketch_get_n_double("k") > 0)
    return per.crossJoin(total).select(  # total is one row
        "column_name", F.col("total").alias("n_rows"), (F.col("nulls") + F.col("total") - F.col("n_seen")).alias("null_count"), "least", "greatest",
        F.hll_sketch_estimate("h").alias("n_distinct"), F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col("k")), at)).alias("quantiles"))
