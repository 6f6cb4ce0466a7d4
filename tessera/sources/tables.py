"""Load a dataset directory of parquet tables (``src_tables``)."""

from __future__ import annotations

import os
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def load_tables(spark: SparkSession, root: str, names=None, register: bool = True) -> dict[str, DataFrame]:
    """Read ``<root>/<name>.parquet`` for every requested table.

    Reading is lazy: only the footers are touched here, so column pruning and
    filter pushdown still reach each scan when a query uses the frame.
    Names are matched case-insensitively, as the catalog subset does.
    """
    wanted = [n.lower() for n in (names or TABLE_NAMES)]
    out = {}
    for name in wanted:
        path = os.path.join(root, f"{name}.parquet")
        df = spark.read.parquet(path)
        if register:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out


def tables(spark: SparkSession, root: str, names=None) -> SimpleNamespace:
    """Attribute access over :func:`load_tables` (``t.lineitem``)."""
    return SimpleNamespace(**load_tables(spark, root, names, register=False))
