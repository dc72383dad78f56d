"""Tables in versions, replaced as a whole by one small file.

A store is a folder. Data files lie in ``<table>/<partition folders>/version=<v>/`` and are never
changed. A commit file in ``_versions`` names, for each table, which version of each partition
counts; the one with the highest number is the store as readers see it. It is created only if it
is not there, so of two writers one fails, and a build that raises leaves what was there before:
its data files are in no commit. One commit may replace some partitions of several tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import _located


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass(frozen=True)
class Part:
    """Rows written for a table: partition folder -> path below the table, and their number."""

    table: str
    schema: T.StructType
    partition_by: tuple[str, ...]
    folders: dict[str, str]
    rows: int


@dataclass(frozen=True)
class Commit:
    """What a store holds: ``tables`` by name, and whatever ``note`` the writer left."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


class Store:
    """Versioned tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commit_path(self, number: int) -> str:
        return f"{self.root}/_versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        """Numbers of all commits, in order."""
        files, target = _located(self.spark, f"{self.root}/_versions")
        if not files.exists(target):
            return []
        names = [status.getPath().getName() for status in files.listStatus(target)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def commit(self, number: int | None = None) -> Commit:
        """The commit of a number, else the newest whole one; an empty one where there is none."""
        for n in reversed(self.numbers()) if number is None else [number]:
            files, target = _located(self.spark, self._commit_path(n))
            stream = files.open(target)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            try:
                found = json.loads(text)
            except ValueError:
                if number is not None:
                    raise
                continue  # its writer died before the end: it was never there
            return Commit(n, found["tables"], found["note"])
        return Commit()

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> Part:
        """Write rows as new partitions of a table; no reader sees them before ``publish``."""
        version = uuid.uuid4().hex
        written = Observation()
        counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
        if partition_by:
            counted = counted.hint("rebalance", *partition_by)
        target = f"{self.root}/{table}"
        counted.withColumn("version", F.lit(version)).write.mode("append").partitionBy(
            *partition_by, "version"
        ).parquet(target)
        folders = {}
        files, path = _located(self.spark, target)
        mine = f"version={version}"
        for status in files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "/".join([*["*=*"] * len(partition_by), mine]))) or []:
            below = "/".join(status.getPath().toString().split("/")[-len(partition_by) - 1:])
            folders[below.removesuffix(mine)] = below
        # nothing is observed where a plan turns out empty
        rows = written.get["rows"] if folders else 0
        return Part(table, df.schema, partition_by, folders, rows)

    def preview(self, parts: Iterable[Part], based_on: Commit, whole: bool = True) -> Commit:
        """What the store would hold with these parts. ``whole`` replaces their tables, else only
        the partitions of the parts are replaced."""
        tables = dict(based_on.tables)
        for part in parts:
            held = {} if whole or part.table not in tables else tables[part.table]["folders"]
            tables[part.table] = {
                "schema": part.schema.jsonValue(), "partition_by": list(part.partition_by),
                "folders": held | part.folders,
            }
        return Commit(based_on.number, tables, based_on.note)

    def publish(
        self, parts: Iterable[Part], based_on: Commit, note: dict | None = None, whole: bool = True
    ) -> Commit:
        """Make the written rows the store's next version, as ``preview`` shows it.

        Raises Conflict if the store is no longer ``based_on``.
        """
        tables = self.preview(parts, based_on, whole).tables
        moved = Conflict(f"{self.root} has moved on from version {based_on.number}")
        if self.commit().number != based_on.number:
            raise moved
        number = max([based_on.number, *self.numbers()]) + 1  # beyond those of writers that died
        files, target = _located(self.spark, self._commit_path(number))
        files.mkdirs(target.getParent())
        note = based_on.note if note is None else note
        try:
            stream = files.create(target, False)
        except Exception as error:
            if files.exists(target):
                raise moved from error
            raise
        stream.write(bytearray(json.dumps({"tables": tables, "note": note}).encode()))
        stream.close()
        return Commit(number, tables, note)

    def replace(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> Commit:
        """Replace one table by a frame, which may read the table itself."""
        base = self.commit()
        return self.publish([self.write(table, df, partition_by)], base)

    def read(self, table: str, commit: Commit | int | None = None, folders: Iterable[str] | None = None) -> DataFrame:
        """A table as of a commit, the newest by default; ``folders`` names the partitions wanted."""
        if not isinstance(commit, Commit):
            commit = self.commit(commit)
        if table not in commit.tables:
            raise KeyError(f"{self.root} has no table {table} in version {commit.number}")
        entry = commit.tables[table]
        schema = T.StructType.fromJson(entry["schema"])
        wanted = entry["folders"] if folders is None else {f: entry["folders"][f] for f in folders if f in entry["folders"]}
        base = f"{self.root}/{table}"
        paths = [f"{base}/{below}" for below in wanted.values()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        typed = T.StructType([*schema.fields, T.StructField("version", T.StringType())])
        reader = self.spark.read.schema(typed).option("basePath", base)
        return reader.parquet(*paths).select(*schema.names)

    def expire(self, keep: int = 2) -> int:
        """Delete commits but the newest ``keep``, and data that none of these holds; how many folders.

        Not to be called while another writer is at work, as its rows are in no commit yet.
        """
        numbers = self.numbers()
        kept = [self.commit(n) for n in numbers[-keep:]]
        held = {f"{t}/{below}" for c in kept for t, e in c.tables.items() for below in e["folders"].values()}
        tables = {(t, len(e["partition_by"])) for n in numbers for t, e in self.commit(n).tables.items()}
        java, gone = self.spark._jvm.org.apache.hadoop.fs.Path, 0
        for table, depth in tables:
            files, path = _located(self.spark, f"{self.root}/{table}")
            for status in files.globStatus(java(path, "/".join([*["*=*"] * depth, "version=*"]))) or []:
                below = "/".join(status.getPath().toString().split("/")[-depth - 1:])
                if f"{table}/{below}" not in held:
                    files.delete(status.getPath(), True)
                    gone += 1
        for n in numbers[:-keep]:
            files, path = _located(self.spark, self._commit_path(n))
            files.delete(path, False)
        return gone


def input_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> dict[str, list[int]]:
    """Files of a folder with length and time of change, from the file system alone."""
    java = spark._jvm.org.apache.hadoop.fs.Path
    files, path = _located(spark, folder)
    if not files.exists(path):
        raise FileNotFoundError(f"folder {folder} not found")
    found = files.globStatus(java(path, pattern)) or []
    return {unquote(s.getPath().toString()): [s.getLen(), s.getModificationTime()] for s in found}


__all__ = ["Commit", "Conflict", "Part", "Store", "input_files"]
