"""Helpers shared by the training-data operators: staging and text batches."""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (``spark.checkpoint.dir``).

    Only a single-machine session (tests) that names none gets a scratch folder;
    on a cluster a missing setting is an error, never a machine-local folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        path = sc.getCheckpointDir()
        if not path:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="tessera-llm-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: a lineage cut
    that survives lost executors and keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-llm/{name}-{uuid.uuid4().hex}"
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


_scope = threading.local()  # what the stages of a pipeline that runs in this thread have staged


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, [df.staged_path])


def release(spark: SparkSession) -> None:
    """Remove what the last stage in this thread has left."""
    _remove(spark, getattr(_scope, "left", []))
    _scope.left = []


def pipeline_stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose staged tables are removed as the next stage begins. By then its
    result has been written, which is what reads them; a caller that does not write it
    must not begin another stage."""
    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        _scope.paths = []
        try:
            return f(spark, docs, sf_dir)
        finally:
            _scope.left, _scope.paths = _scope.paths, None
    return stage


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character untouched."""
    return F.translate(c, UPPER, UPPER.lower())


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def is_local(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` holds at most ``max_rows`` rows (reads no more than that)."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint behind a fresh size check; beyond it, a shuffle join."""
    return F.broadcast(df) if is_local(df, max_rows) else df


def extended(fields: list[T.StructField], ddl: str) -> T.StructType:
    """A schema of given fields, whatever their names, and further ones."""
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])


ROW_BITS = 27


def is_plain_read(docs: DataFrame) -> bool:
    """True if the rows of ``docs`` are those of the Parquet files it reads, one by one."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    files = docs.inputFiles()
    return bool(files) and docs.count() == docs.sparkSession.read.parquet(*files).count()


def row_number(docs: DataFrame) -> Column:
    """A number of each row of ``docs``, a plain read of Parquet files: 36 bits of a hash
    of its file's name and its place in the file. Every scan gives the same, however the
    files are split. The hash is salted until no two files share it."""
    spark, files = docs.sparkSession, docs.inputFiles()

    def prefix(path: Column, salt: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(path, F.lit(salt)), 64 - 63 + ROW_BITS)

    named = spark.createDataFrame([(f,) for f in files], "f string")
    salt = next(s for s in range(1000) if named.select(prefix(F.col("f"), s)).distinct().count() == len(files))
    at = F.col("_metadata.row_index")
    place = F.when(at < 1 << ROW_BITS, at).otherwise(F.raise_error(F.lit(f"a file of more than {1 << ROW_BITS} rows")).cast("long"))
    return F.shiftleft(prefix(F.col("_metadata.file_path"), salt), ROW_BITS).bitwiseOR(place)
