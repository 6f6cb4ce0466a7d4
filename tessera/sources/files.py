"""Run files: questions, run logs and lessons with explicit schemas and defaults,
file discovery, and safe writers. Nothing is inferred; old files that lack newer
columns load with defaults (additive schema evolution)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import printed
from .versions import current, publish, update, write_with_backup  # noqa: F401  (the library's writers, here for its users)

QUESTION_SCHEMA = T.StructType([
    T.StructField("question_id", T.StringType()), T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()), T.StructField("evidence", T.StringType()),
    T.StructField("SQL", T.StringType()), T.StructField("difficulty", T.StringType())])

RUN_SCHEMA = T.StructType([
    T.StructField("arm", T.StringType()), T.StructField("question_id", T.StringType()),
    T.StructField("db_id", T.StringType()), T.StructField("difficulty", T.StringType()),
    T.StructField("correct", T.BooleanType()), T.StructField("draft_correct", T.BooleanType()),
    T.StructField("reason", T.StringType()), T.StructField("sql", T.StringType()),
    T.StructField("draft_sql", T.StringType()), T.StructField("calls", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()), T.StructField("repaired", T.BooleanType()),
    T.StructField("agents", T.ArrayType(T.StringType())), T.StructField("memory", T.BooleanType()),
    T.StructField("lessons_recalled", T.IntegerType()), T.StructField("lesson_learned", T.BooleanType()),
    T.StructField("written_at", T.TimestampType()), T.StructField("_corrupt_record", T.StringType())])

LESSON_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("db_id", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("broken_sql", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("fixed_sql", T.StringType()), T.StructField("recorded_at", T.TimestampType()),
    T.StructField("_corrupt_record", T.StringType())])


def load_questions(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """evidence missing/NULL → '', difficulty missing → 'unknown', id cast to int,
    ``SQL`` renamed ``gold_sql``."""
    df = spark.read.schema(QUESTION_SCHEMA).option("multiLine", multiline).json(path)
    return df.select(F.col("question_id").cast("int").alias("question_id"), "db_id", "question",
                     F.coalesce("evidence", F.lit("")).alias("evidence"), F.col("SQL").alias("gold_sql"),
                     F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"))


def _at(spark: SparkSession, path: str):
    """Hadoop file system and path of ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Missing file → empty frame; corrupt lines dropped (PERMISSIVE); columns
    added later default; duplicate (arm, question) → the last write wins: the latest
    ``written_at`` (rows without one come first), then the later file and line. A
    versioned log is read at its published version."""
    path = current(spark, path) or path
    if not _exists(spark, path):
        return spark.createDataFrame([], RUN_SCHEMA).drop("_corrupt_record")
    df = (spark.read.schema(RUN_SCHEMA).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("_place")
    df = df.select("*", place).where(F.col("_corrupt_record").isNull() & F.col("arm").isNotNull()).drop("_corrupt_record")
    df = df.select(*[c for c in df.columns if c not in ("memory", "lessons_recalled", "lesson_learned", "draft_sql", "agents")],
                   F.coalesce("draft_sql", F.lit("")).alias("draft_sql"),
                   F.coalesce("agents", F.array().cast("array<string>")).alias("agents"),
                   F.coalesce("memory", F.lit(False)).alias("memory"),
                   F.coalesce("lessons_recalled", F.lit(0)).alias("lessons_recalled"),
                   F.coalesce("lesson_learned", F.lit(False)).alias("lesson_learned"))
    cols = [c for c in df.columns if c not in ("arm", "question_id", "_place")]
    latest = df.groupBy("arm", "question_id").agg(F.max_by(F.struct(*cols), F.struct("written_at", "_place")).alias("_r"))
    return latest.select("arm", "question_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def load_lessons(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], LESSON_SCHEMA).drop("_corrupt_record")
    df = (spark.read.schema(LESSON_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return (df.where(F.col("_corrupt_record").isNull() & F.col("seq").isNotNull()).drop("_corrupt_record")
            .withColumn("db_id", F.coalesce("db_id", F.lit(""))))


def discover_tables(spark: SparkSession, root: str, suffix: str = ".parquet") -> list[tuple[str, str]]:
    """``(id, path)`` of the dataset files or folders under ``root`` that end in
    ``suffix``, in order: id = name without it; the first path wins for a repeated id.
    Folders named so are datasets and not descended into; only names are read."""
    fs, top = _at(spark, root)
    found, todo = {}, [top]
    while todo:
        for s in sorted(fs.listStatus(todo.pop(0)), key=lambda s: s.getPath().toString()):
            path = s.getPath()
            if path.getName().endswith(suffix):
                found.setdefault(path.getName().removesuffix(suffix), path.toString())
            elif s.isDirectory() and not path.getName().startswith(("_", ".")):
                todo.append(path)
    return sorted(found.items())


def save_runs(df: DataFrame, path: str, base: int | None = None) -> None:
    """Replace the run log in one switch; with ``base`` only if it still is the version
    that ``df`` was built on (see :mod:`versions`)."""
    publish(df, path, "json", base)


def add_runs(df: DataFrame, path: str) -> None:
    """Fold runs into the log: one row per (arm, question), the new one if there is one.
    Rows that another writer adds meanwhile are kept."""
    key = ["arm", "question_id"]
    update(df.sparkSession, path, "json",
           lambda now: df if now is None else now.join(df.select(*key).distinct(), key, "left_anti").unionByName(df, allowMissingColumns=True))


def write_cache(df: DataFrame, path: str) -> None:
    """Key/value responses sharded by the key's first two characters."""
    df.withColumn("shard", F.substring("key", 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(path)


RECOVERED = "recovered from notebook output"  # fixed value
NOTEBOOK_SCHEMA = ("cells array<struct<cell_type:string, outputs:array<struct<output_type:string, "
                   "data:struct<`text/plain`:array<string>>>>>>")
_PRINTED = {"db_id": "", "difficulty": "", "correct": False, "draft_correct": False, "calls": 0, "seconds": 0.0, "repaired": False, "agents": ()}
_PRINTED_SCHEMA = ("file string, cell int, output int, at int, arm string, question_id long, db_id string, difficulty string, correct boolean, draft_correct boolean, "
                   "calls int, seconds double, repaired boolean, agents array<string>, complete boolean")


def _like(value, default):
    """A printed value of the default's kind, else the default."""
    if isinstance(default, tuple):
        return [str(x) for x in value] if isinstance(value, list) else []
    if isinstance(default, bool) or isinstance(default, str):
        return value if type(value) is type(default) else default
    return type(default)(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else default


def recover_rows(spark: SparkSession, path: str) -> DataFrame:
    """Run rows from the outputs of executed notebooks (JSON, one per file): every
    ``Row(...)`` that a cell's final expression printed (:mod:`printed`). Rows without an
    arm or id are skipped; of several rows of an (arm, question) in a notebook the last
    counts, then the lexically last notebook. Fields that a cut row has lost have their
    defaults and ``complete`` is false. The SQL texts may be cut in print and are ''."""
    books = spark.read.schema(NOTEBOOK_SCHEMA).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), "cells")
    outputs = (books.select("file", F.posexplode("cells").alias("cell", "c"))
               .select("file", "cell", F.posexplode("c.outputs").alias("output", "o")).where(F.col("o.output_type") == "execute_result")
               .select("file", "cell", "output", F.array_join(F.col("o.data").getField("text/plain"), "").alias("text")))

    def scan(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                for at, (x, complete) in enumerate(printed.rows(r["text"] or "")):
                    arm, qid = x.get("strategy"), x.get("question_id")
                    if isinstance(arm, str) and arm and type(qid) is int:
                        found.append({"file": r["file"], "cell": r["cell"], "output": r["output"], "at": at, "arm": arm, "question_id": qid, "complete": complete}
                                     | {c: _like(x.get(c, d), d) for c, d in _PRINTED.items()})
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    arrow = pa.schema([("file", pa.string()), *[(c, pa.int32()) for c in ("cell", "output", "at")], ("arm", pa.string()), ("question_id", pa.int64()), ("db_id", pa.string()),
                       ("difficulty", pa.string()), ("correct", pa.bool_()), ("draft_correct", pa.bool_()), ("calls", pa.int32()), ("seconds", pa.float64()),
                       ("repaired", pa.bool_()), ("agents", pa.list_(pa.string())), ("complete", pa.bool_())])
    rows = outputs.mapInArrow(scan, _PRINTED_SCHEMA).withColumn("_place", F.struct("file", "cell", "output", "at"))
    cols = [*_PRINTED, "complete"]
    last = rows.groupBy("arm", "question_id").agg(F.max_by(F.struct(*cols), "_place").alias("r"))
    return last.select("arm", "question_id", *[F.col(f"r.{c}").alias(c) for c in cols],
                       F.lit("").alias("sql"), F.lit("").alias("draft_sql"), F.lit(RECOVERED).alias("reason"))
