"""Key -> (Spark callable, oracle SQL) registry used by ``__spark_entry__``.

A callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame. The oracle is
DuckDB SQL over the same parquet files (views named after the tables), or None
for operators that plain SQL cannot express (checked by unit tests instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def bigint_counts(sql: str) -> str:
    """DuckDB types ``count_if`` as HUGEINT; wrap each call in a BIGINT cast so
    the oracle's integer columns have Spark's type."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "CAST(" + sql[j:k] + " AS BIGINT)")
        i = k


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = bigint_counts(sql)
        return fn
    return deco


def on_tables(key: str, op, sql: str | None = None, **kw):
    """Register ``op(tables_namespace, **kw)``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(tables(spark, sf_dir), **kw)
    run.__name__ = key
    register(key, sql)(run)
    return run


def load_all():
    from . import (  # noqa: F401
        keys_agg, keys_grd, keys_misc, keys_pro, keys_pth, keys_rel, keys_sim, keys_src, keys_str, keys_val,
    )
    return QUERIES, ORACLE
