"""Versioned tables: a log of whole states, each committed on the one it was built on.

``<table>/_log/000000000007`` is a JSON marker: its version, the one before (``base``),
the time, the operation, the ``state`` (any JSON value, the whole of it) and the data
folders it needs. A commit writes its marker under a temporary name and then gives it its
final name without overwriting: one of several writers that built on the same version
gets the next number, the others get ``Conflict`` and start again from the new head.
A marker is whole or absent, data folders are written before it and have names of their
own, so a writer that dies at any step leaves the table as it was.

Naming without overwriting is a hard link on a local file system and a rename with
``NONE`` elsewhere (atomic on HDFS). Object stores without an atomic rename are not
supported.

``vacuum`` removes versions that were superseded longer ago than ``retain_s`` (the newest
two always stay) and folders that no remaining version needs, unless they are younger
than ``retain_s``: readers may go on with a version that long, and a writer may take that
long to commit.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

RETAIN_S = 3600.0
TRIES = 100


class Conflict(RuntimeError):
    """Another writer has committed on the same version."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    state: Any = None
    folders: list[str] = field(default_factory=list)
    at: float = 0.0
    op: str = ""


class VersionLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[tuple[str, float]]:
        p = self._path(f"{self.path}/{folder}")
        if not self._fs.exists(p):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(p)]

    def numbers(self) -> list[int]:
        return sorted(int(name) for name, _ in self._names("_log") if name.isdigit())

    def read(self, number: int) -> Version:
        stream = self._fs.open(self._path(f"{self.path}/_log/{number:012d}"))
        try:
            told = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(told["version"], told["state"], told["folders"], told["at"], told["op"])

    def head(self) -> Version:
        """The newest version; number 0 and no state before the first commit."""
        known = self.numbers()
        return self.read(known[-1]) if known else Version()

    def folder(self) -> str:
        """A fresh name, relative to the table, for a data folder."""
        return f"versions/{uuid.uuid4().hex}"

    def commit(self, base: int, state: Any, folders: list[str], op: str = "write") -> Version:
        """Make ``state`` version ``base + 1``; ``Conflict`` if there is one."""
        number = base + 1
        told = {"version": number, "base": base, "at": time.time(), "op": op, "state": state, "folders": sorted(folders)}
        temporary, final = self._path(f"{self.path}/_log/.{uuid.uuid4().hex}.tmp"), self._path(f"{self.path}/_log/{number:012d}")
        stream = self._fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(told).encode()))
        finally:
            stream.close()
        try:
            known = self.numbers()
            if known and known[-1] > base or not known and base:
                raise Conflict(f"{self.path}: built on version {base}, the head is {known[-1] if known else 0}")
            self._name(temporary, final)
        finally:
            self._fs.delete(temporary, False)
        return Version(number, state, told["folders"], told["at"], op)

    def _name(self, temporary, final) -> None:
        """Give a file its final name unless that is taken."""
        try:
            if self._fs.getUri().getScheme() == "file":
                at = self._jvm.java.nio.file.Paths.get
                none = self._jvm.java.net.URI.create
                self._jvm.java.nio.file.Files.createLink(at(none("file://" + final.toUri().getRawPath())), at(none("file://" + temporary.toUri().getRawPath())))
            else:
                self._rename(temporary, final)
        except Exception:
            if self._fs.exists(final):
                raise Conflict(f"{final} was committed by another writer") from None
            raise

    def _rename(self, temporary, final) -> None:
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(temporary, final, how)

    def change(self, step: Callable[[Version], tuple[Any, list[str]] | None], op: str = "write") -> Version:
        """Commit ``step(head)``, again from the new head as long as others come between.
        ``None`` leaves the table as it is."""
        for _ in range(TRIES):
            head = self.head()
            made = step(head)
            if made is None:
                return head
            try:
                return self.commit(head.number, *made, op)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {TRIES} commits in a row came between")

    def vacuum(self, retain_s: float = RETAIN_S) -> None:
        known, now = self.numbers(), time.time()
        kept = [self.read(n) for n in known[-2:]]
        for n in reversed(known[:-2]):
            if kept[0].at >= now - retain_s:  # the version after it, which superseded it
                kept.insert(0, self.read(n))
        for n in known[:len(known) - len(kept)]:
            self._delete(f"_log/{n:012d}")
        needed = {f.split("/")[1] for v in kept for f in v.folders if f.startswith("versions/")}
        for name, modified in self._names("versions"):
            if name not in needed and modified <= now - retain_s:
                self._delete(f"versions/{name}")
        for name, modified in self._names("_log"):
            if name.endswith(".tmp") and modified <= now - max(retain_s, 60):
                self._delete(f"_log/{name}")

    def _delete(self, name: str) -> None:
        p = self._path(f"{self.path}/{name}")
        if not self._fs.delete(p, True) and self._fs.exists(p):
            raise OSError(f"could not remove {p}")


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the published version of a table, None if there is none."""
    head = VersionLog(spark, path).head()
    return f"{path.rstrip('/')}/{head.state}" if head.number else None


def publish(df: DataFrame, path: str, fmt: str, base: int | None = None, retain_s: float = RETAIN_S) -> str:
    """Replace a table by ``df``, whose rows go to a folder of their own. With ``base``,
    the version that ``df`` was built on, ``Conflict`` if it is no longer the head;
    without, the table is replaced whatever it is."""
    log = VersionLog(df.sparkSession, path)
    if base is not None and log.head().number != base:
        raise Conflict(f"{path}: built on version {base}")
    folder = log.folder()
    df.write.format(fmt).save(f"{log.path}/{folder}")
    if base is None:
        log.change(lambda head: (folder, [folder]))
    else:
        log.commit(base, folder, [folder])
    log.vacuum(retain_s)
    return f"{log.path}/{folder}"


def update(spark: SparkSession, path: str, fmt: str, change: Callable[[DataFrame | None], DataFrame], retain_s: float = RETAIN_S) -> str:
    """Replace a table by ``change`` of its rows (None at first). If another writer
    commits meanwhile, ``change`` is made again on what it left, so nothing is lost."""
    log = VersionLog(spark, path)
    for _ in range(TRIES):
        head = log.head()
        now = spark.read.format(fmt).load(f"{log.path}/{head.state}") if head.number else None
        try:
            return publish(change(now), path, fmt, head.number, retain_s)
        except Conflict:
            continue
    raise Conflict(f"{path}: {TRIES} commits in a row came between")


def write_with_backup(df: DataFrame, path: str, backup: str, retain_s: float = RETAIN_S) -> None:
    """Replace a table after its first version was kept in ``backup``, once, whoever
    writes: the backup is committed as version 1 of its own table or not at all, and no
    change is committed before there is one."""
    spark = df.sparkSession
    table, kept = VersionLog(spark, path), VersionLog(spark, backup)
    for _ in range(TRIES):
        head = table.head()
        try:
            if head.number and not kept.head().number:
                publish(spark.read.parquet(f"{table.path}/{head.state}"), backup, "parquet", 0, retain_s)
        except Conflict:
            pass  # another writer has kept it
        try:
            publish(df, path, "parquet", head.number, retain_s)
            return
        except Conflict:
            continue
    raise Conflict(f"{path}: {TRIES} commits in a row came between")
