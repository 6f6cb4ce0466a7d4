"""Broadcasts with a proven size bound.

Spark already broadcasts a join side whose *estimated* size is under
``spark.sql.autoBroadcastJoinThreshold``, and AQE converts a sort-merge join to a
broadcast once the real shuffle size is known. We add an explicit hint only when
the side is provably small:

* ``one_row`` — a global aggregate: exactly one row by construction;
* ``bounded`` — a side whose row count is checked with a *bounded* action
  (``limit(max_rows + 1).count()`` never reads more than ``max_rows + 1`` rows;
  it runs each time, since the data behind the same plan may have grown)
  and broadcast only if it fits; otherwise the frame is returned unhinted and
  the join stays a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 100_000


def one_row(df: DataFrame) -> DataFrame:
    """Hint a global aggregate (exactly one row) for broadcast."""
    return F.broadcast(df)


def bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it holds at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
