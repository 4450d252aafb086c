"""Tables of a folder that change together: each change is one numbered record, and readers see whole changes only.

A record lists, for every table, the files that make it up in order: rows that were added, and keys whose earlier
rows are gone (tombstones). A change writes its files first and its record last. A record is published only if its
number is free, so of two writers that start from the same state one wins and the other gets ``Conflict``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of more parts than this is written anew as one part by the change that makes it so.
MOST_PARTS = 24
#: Parts of a change that are written at a time.
WRITERS = 4


class Conflict(RuntimeError):
    """Another writer has published the next change."""


class Unreadable(RuntimeError):
    """The register of changes is damaged; whoever writes must not go on from an older or empty state."""


class _Register:
    """Records as small files ``commits/<number>.json``, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self.folder = folder
        self.fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, part: str) -> list[str]:
        path = self._path(f"{self.folder}/{part}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names("commits") if n.removesuffix(".json").isdigit()]

    def read(self, number: int) -> dict:
        """A record; ValueError where it is no record."""
        stream = self.fs.open(self._path(self._name(number)))
        try:
            found = json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if not isinstance(found, dict) or not isinstance(found.get("tables"), dict):
            raise ValueError("no record")
        return found

    def publish(self, number: int, record: dict) -> None:
        """Write beside its place and move it there; both ways of moving fail where the place is taken.

        On a local file system that is a hard link, on others their rename, which must not replace (as HDFS's does not).
        """
        target, beside = self._name(number), f"{self.folder}/commits/.{number}-{uuid.uuid4().hex}"
        out = self.fs.create(self._path(beside), False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        if self.fs.getScheme() == "file":
            local = lambda p: self._path(p).toUri().getPath()
            try:
                os.link(local(beside), local(target))
            except FileExistsError:
                raise Conflict(f"change {number} is taken") from None
            finally:
                self.fs.delete(self._path(beside), False)
        elif not self.fs.rename(self._path(beside), self._path(target)):
            self.fs.delete(self._path(beside), False)
            raise Conflict(f"change {number} is taken")

    def _name(self, number: int) -> str:
        return f"{self.folder}/commits/{number:012d}.json"


@dataclass
class Change:
    """What a change does to a table: rows to add, and keys (columns of any names of the table) whose earlier rows go."""

    rows: DataFrame | None = None
    gone: list[DataFrame] = field(default_factory=list)


class Snapshot:
    """All tables as of one change."""

    def __init__(self, store: Store, number: int, record: dict):
        self.store, self.number, self.record = store, number, record

    def table(self, name: str) -> DataFrame:
        return self.store._merged(name, self.record["tables"].get(name, []))


class Store:
    """Tables (name to schema, as DDL) in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self._register = _Register(spark, self.folder)
        self._read: dict[str, bool] = {}  # files never change, so each is looked at once

    def _merged(self, name: str, parts: list[dict]) -> DataFrame:
        """Rows of all parts without those that a later part's keys take away; keys of one part spare its own change's rows."""
        schema = self.spark.createDataFrame([], self.schemas[name]).schema
        read = lambda p: self.spark.read.parquet(f"{self.folder}/{p['path']}")
        rows = [read(p).select(*schema.names).withColumn("_at", F.lit(p["number"])) for p in parts if not p["keys"]]
        if not rows:
            return self.spark.createDataFrame([], schema)
        found = reduce(DataFrame.unionByName, rows)
        first = min(p["number"] for p in parts if not p["keys"])
        later = [p for p in parts if p["keys"] and p["number"] > first]
        for keys in sorted({tuple(p["keys"]) for p in later}):
            gone = reduce(DataFrame.unionByName, [read(p).select(*keys).withColumn("_until", F.lit(p["number"])) for p in later if tuple(p["keys"]) == keys])
            found = found.join(gone.groupBy(*keys).agg(F.max("_until").alias("_until")), list(keys), "left").where("_until is null or _at >= _until").drop("_until")
        return found.select(*schema.names)

    def _sound(self, record: dict) -> bool:
        """Whether all files of a record's tables are there, are Parquet and have the tables' columns."""
        try:
            return all(self._part(name, part) for name in self.schemas for part in record["tables"].get(name, []))
        except (KeyError, TypeError):
            return False

    def _part(self, name: str, part: dict) -> bool:
        if part["path"] not in self._read:
            wanted = {(f.name, f.dataType) for f in self.spark.createDataFrame([], self.schemas[name]).schema if not part["keys"] or f.name in part["keys"]}
            try:
                self._read[part["path"]] = wanted <= {(f.name, f.dataType) for f in self.spark.read.parquet(f"{self.folder}/{part['path']}").schema}
            except (PySparkException, Py4JJavaError):
                self._read[part["path"]] = False
        return self._read[part["path"]]

    def snapshot(self, at: int | None = None) -> Snapshot:
        """For readers: the newest change that can be read (up to ``at``); empty tables where there is none."""
        try:
            numbers = self._register.numbers()
        except (Py4JJavaError, ValueError):
            numbers = []
        for number in sorted(numbers, reverse=True):
            if at is None or number <= at:
                try:
                    record = self._register.read(number)
                except (Py4JJavaError, ValueError):
                    continue
                if self._sound(record):
                    return Snapshot(self, number, record)
        return Snapshot(self, 0, {"tables": {}})

    def for_writing(self) -> Snapshot:
        """For writers: the last change; ``Unreadable`` where it cannot be read or changes are missing.

        A folder that was never written gets an empty first record before any data, so data without a record, a gap
        between records, or data that is two changes ahead of the last record show that records were lost.
        """
        try:
            numbers = self._register.numbers()
            written = [int(n.split("-")[0]) for n in self._register.names("data")]
            if not numbers and not written:
                self._publish_first()
                numbers = [0]
            if not numbers or numbers != list(range(numbers[0], numbers[-1] + 1)) or max(written, default=0) > numbers[-1] + 1:
                raise Unreadable(f"records of {self.folder} are missing")
            record = self._register.read(numbers[-1])
        except (Py4JJavaError, ValueError) as error:
            raise Unreadable(f"the register of {self.folder} cannot be read: {str(error)[:300]}") from error
        if not self._sound(record):
            raise Unreadable(f"files of change {numbers[-1]} of {self.folder} cannot be read")
        return Snapshot(self, numbers[-1], record)

    def _publish_first(self) -> None:
        try:
            self._register.publish(0, {"tables": {}})
        except Conflict:
            pass  # another writer has just done so

    def commit(self, base: Snapshot, changes: dict[str, Change], **notes) -> Snapshot:
        """Publish changes made from ``base``; ``Conflict`` where another change came first, whose tables then stand."""
        number = base.number + 1
        folder = f"data/{number:012d}-{uuid.uuid4().hex}"
        tables, writes = {name: list(parts) for name, parts in base.record["tables"].items()}, []
        for name, change in changes.items():
            rows = [] if change.rows is None else [(change.rows.select(*self.spark.createDataFrame([], self.schemas[name]).columns), [])]
            for k, (df, keys) in enumerate([*((g, g.columns) for g in change.gone), *rows]):
                path = f"{folder}/{name}-{k}"
                writes.append((df, path))
                tables.setdefault(name, []).append({"path": path, "number": number, "keys": keys})
        with ThreadPoolExecutor(WRITERS) as pool:  # the parts do not depend on each other
            list(pool.map(lambda w: w[0].write.parquet(f"{self.folder}/{w[1]}"), writes))
        for name, parts in tables.items():
            if len(parts) > MOST_PARTS:
                path = f"{folder}/{name}-whole"
                self._merged(name, parts).write.parquet(f"{self.folder}/{path}")
                tables[name] = [{"path": path, "number": number, "keys": []}]
        record = {"tables": tables, **notes}
        self._register.publish(number, record)
        return Snapshot(self, number, record)

    def update(self, change: Callable[[Snapshot], dict[str, Change] | None], attempts: int = 5, **notes) -> Snapshot:
        """Commit what ``change`` makes of the last snapshot, again from the newer one where another writer came first."""
        for left in reversed(range(attempts)):
            base = self.for_writing()
            made = change(base)
            if not made:
                return base
            try:
                return self.commit(base, made, **notes)
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be positive")

    def noted(self, name: str, value) -> Snapshot | None:
        """The newest change with a note of this value."""
        for number in sorted(self._register.numbers(), reverse=True):
            record = self._register.read(number)
            if record.get(name) == value:
                return Snapshot(self, number, record)
        return None


def replacing(rows: DataFrame, *key: str) -> Change:
    """Rows that take the place of those with the same key."""
    return Change(rows, [rows.select(*key).distinct()])
