"""A user's fetch function as a Spark data source: partitioned, in batch and as a stream, with what failed in a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from statuta.sources import crawl

SCHEMA = "origin string, value string, error string"


class _Part(InputPartition):
    def __init__(self, origin: str, start: int = 0, end: int | None = None):
        self.origin, self.start, self.end = origin, start, end


def _rows(fetch: Callable, part: _Part) -> Iterator[tuple]:
    """Items as JSON texts; what fetch raises is a row with an error, so that one bad partition does not end the job."""
    try:
        for item in fetch(part.origin, part.start, part.end):
            yield part.origin, item if isinstance(item, str) else json.dumps(item, ensure_ascii=False, default=str), None
    except Exception as error:
        yield part.origin, None, f"{type(error).__name__}: {error}"[:2000]


def register(spark: SparkSession, fetch: Callable[[str, int, int | None], Iterable[dict | str]], origins: Iterable[str], latest: Callable[[str], int] | None = None) -> str:
    """Make a data source of a function and return its name for ``spark.read.format`` and ``spark.readStream.format``.

    ``fetch(origin, start, end)`` runs inside the tasks, one partition for each of ``origins``, and gives items as
    dicts or JSON texts; a batch asks from 0 to None. For a stream ``latest(origin)`` tells on the driver how far an
    origin reaches, and each micro-batch asks from the last end to that one; equal offsets must give equal items, so a
    batch that runs again reads the same. Columns are origin, value (an item) and error.
    """
    names, title = list(origins), f"connector_{uuid.uuid4().hex[:12]}"

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Part(n) for n in names]

        def read(self, partition):
            yield from _rows(fetch, partition)

    class Stream(DataSourceStreamReader):
        def initialOffset(self):
            return dict.fromkeys(names, 0)

        def latestOffset(self):
            return {n: latest(n) for n in names}

        def partitions(self, start, end):
            return [_Part(n, start[n], end[n]) for n in names if end[n] > start[n]]

        def read(self, partition):
            yield from _rows(fetch, partition)

        def commit(self, end):
            """Nothing is kept by the source."""

    class Connector(DataSource):
        @classmethod
        def name(cls):
            return title

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):
            if latest is None:
                raise ValueError("a stream needs a function latest(origin)")
            return Stream()

    spark.dataSource.register(Connector)
    return title


def fetched(rows: DataFrame, kind: str, relations: Callable[[DataFrame], DataFrame] | None = None, extend: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, relations, status, quarantine) of rows (origin, value, error), as a sync takes them.

    An origin with an error is in status with its fetch_error and gives no documents, not even those that came before
    it failed. Items that are none go to quarantine (origin, value, reason). ``relations`` makes edges (src, type, dst)
    of the parsed items, by default an item's own and its kind's field; ``extend`` changes the documents before they
    are taken.
    """
    status = rows.groupBy("origin").agg(F.min("error").alias("fetch_error"))
    items = rows.where("value is not null").join(status.where("fetch_error is not null"), "origin", "left_anti")
    parsed = crawl.parse(items)
    documents = crawl.documents(parsed, kind, keep=("origin",))
    return (extend(documents) if extend else documents), (relations or (lambda p: crawl.convenience_edges(p, kind)))(parsed), status, parsed.where("reason is not null").select("origin", "value", "reason")
