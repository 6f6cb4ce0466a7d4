"""Keyed tables that take small changes: bucketed delta files, merged on read.

An upsert reduces its rows to one per key, deals them to ``buckets`` by a hash of the key
and writes them as one delta folder; the table's other files are not read or written.
Readers merge the deltas: of the rows of a key the one that is last by ``order`` counts.

Deltas of a bucket are kept in tiers. As soon as a bucket holds ``FAN`` deltas of a tier
they are merged into one of the next tier, that bucket's files alone, so a row is
rewritten once for each tier it climbs and a bucket has fewer than ``FAN`` deltas a tier.
Both steps commit to a version log. An upsert does not depend on what else the table
holds, so on a conflict it is committed on the new head as it is; a merge is given up if
one of its deltas has gone. A writer that names itself and numbers its batches (a stream
and its epochs) has each batch applied once, however often it is delivered.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.attempts import latest_per_key
from .versions import RETAIN_S, Version, VersionLog

BUCKETS = 16
FAN = 8


class KeyedTable:
    """``keys``, ``order`` and ``values`` are columns; ``order`` may be among the values.
    ``order`` should be total, so that the last row does not depend on the merge."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], values: list[str], buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.log = spark, VersionLog(spark, path)
        self.keys, self.order, self.values, self.buckets, self.fan = keys, order, values, buckets, fan
        self.columns = list(dict.fromkeys([*keys, *order, *values]))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _last(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, self.keys, self.order, [c for c in self.columns if c not in self.keys]).select(*self.columns)

    def _write(self, rows: DataFrame, n_buckets: int) -> tuple[str, list[int]]:
        """One delta folder, and the buckets it has files for."""
        folder = self.log.folder()
        path = f"{self.log.path}/{folder}"
        rows.withColumn("_bucket", self._bucket()).repartition(max(1, n_buckets), "_bucket").write.partitionBy("_bucket").parquet(path)
        fs_path = self.log._path(path)
        found = [s.getPath().getName() for s in self.log._fs.listStatus(fs_path)]
        return folder, sorted(int(x.removeprefix("_bucket=")) for x in found if x.startswith("_bucket="))

    def _paths(self, deltas: list[dict], only: set[int] | None = None) -> list[str]:
        return [f"{self.log.path}/{d['folder']}/_bucket={b}" for d in deltas for b in d["buckets"] if only is None or b in only]

    def _empty(self) -> dict:
        return {"buckets": self.buckets, "schema": None, "deltas": [], "writers": {}}

    def _state(self, head: Version) -> dict:
        state = head.state or self._empty()
        if state["buckets"] != self.buckets:
            raise ValueError(f"{self.log.path} has {state['buckets']} buckets, not {self.buckets}")
        return state

    @staticmethod
    def _folders(state: dict) -> list[str]:
        return [d["folder"] for d in state["deltas"]]

    def upsert(self, batch: DataFrame, writer: str | None = None, epoch: int | None = None) -> bool:
        """Add a batch; False if ``writer`` has committed this ``epoch`` or a later one."""
        def done(state: dict) -> bool:
            return writer is not None and epoch is not None and state["writers"].get(writer, -1) >= epoch

        if done(self._state(self.log.head())):
            return False
        rows = self._last(batch.select(*self.columns))
        folder, touched = self._write(rows, self.buckets)
        repeated = False

        def step(head: Version):
            nonlocal repeated
            state = self._state(head)
            repeated = done(state)
            if repeated:
                return None
            deltas = state["deltas"] + ([{"folder": folder, "buckets": touched, "tier": 0}] if touched else [])
            writers = state["writers"] | ({writer: epoch} if writer is not None and epoch is not None else {})
            new = state | {"schema": rows.schema.jsonValue(), "deltas": deltas, "writers": writers}
            return new, self._folders(new)

        self.log.change(step, "upsert")
        return not repeated

    def _due(self, state: dict) -> tuple[int, dict[int, list[int]]]:
        """A tier that has buckets with ``fan`` deltas, and their places by bucket."""
        per: dict[tuple[int, int], list[int]] = {}
        for at, d in enumerate(state["deltas"]):
            for b in d["buckets"]:
                per.setdefault((d["tier"], b), []).append(at)
        full = {k: v for k, v in per.items() if len(v) >= self.fan}
        tier = min((t for t, _ in full), default=-1)
        return tier, {b: at for (t, b), at in full.items() if t == tier}

    def compact(self, retain_s: float = RETAIN_S) -> int:
        """Merge what is due, tier by tier; how many merges were committed."""
        merges = 0
        while True:
            head = self.log.head()
            if not head.number:
                return merges
            state = self._state(head)
            tier, due = self._due(state)
            if not due:
                if merges:
                    self.log.vacuum(retain_s)
                return merges
            paths = [f"{self.log.path}/{state['deltas'][at]['folder']}/_bucket={b}" for b, places in due.items() for at in places]
            folder, touched = self._write(self._last(self._read(state, paths)), len(due))
            gone = {(state["deltas"][at]["folder"], b) for b, places in due.items() for at in places}

            def step(now: Version, folder=folder, touched=touched, gone=gone, tier=tier):
                state = self._state(now)
                there = {(d["folder"], b) for d in state["deltas"] for b in d["buckets"]}
                if not gone <= there:
                    return None  # another writer has merged some of them
                deltas = [d | {"buckets": [b for b in d["buckets"] if (d["folder"], b) not in gone]} for d in state["deltas"]]
                new = state | {"deltas": [{"folder": folder, "buckets": touched, "tier": tier + 1}, *[d for d in deltas if d["buckets"]]]}
                return new, self._folders(new)

            self.log.change(step, "compact")
            merges += 1

    def _read(self, state: dict, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(state["schema"])).parquet(*paths)

    def rows(self) -> DataFrame:
        """The table now, one row per key."""
        state = self._state(self.log.head())
        paths = self._paths(state["deltas"])
        if not paths:
            if state["schema"] is None:
                raise LookupError(f"{self.log.path} has never been written")
            return self.spark.createDataFrame([], T.StructType.fromJson(state["schema"]))
        return self._last(self._read(state, paths))

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys: only the buckets that they fall into are read."""
        wanted = keys.select(*self.keys).distinct()
        buckets = {r[0] for r in wanted.select(self._bucket().alias("b")).distinct().collect()}  # at most the buckets
        state = self._state(self.log.head())
        paths = self._paths(state["deltas"], buckets)
        rows = self._read(state, paths) if paths else self.rows().limit(0)
        match = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.keys])
        return self._last(rows.alias("l").join(wanted.alias("r"), match, "left_semi"))

    def depth(self) -> int:
        """Most deltas that a bucket's reader merges."""
        per: dict[int, int] = {}
        for d in self._state(self.log.head())["deltas"]:
            for b in d["buckets"]:
                per[b] = per.get(b, 0) + 1
        return max(per.values(), default=0)

    def most(self, batches: int) -> int:
        """The bound of ``depth`` after so many batches and their merges."""
        return (self.fan - 1) * (1 + int(math.log(max(batches, 1), self.fan)))
