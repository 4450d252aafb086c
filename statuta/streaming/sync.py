"""Source snapshots as a stream: each arriving batch brings the state up to date, once however often it runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.lineage import cut, shared_folder
from statuta.operators.state import removed
from statuta.operators.store import Change, Store


def store(spark: SparkSession, folder: str, feed: DataFrame) -> Store:
    """The tables of a stream: ``state`` (source, entity_id), what is known; ``removed`` and ``errors`` by batch."""
    kinds = {f.name: f.dataType.simpleString() for f in feed.schema}
    key = f"source {kinds['source']}, entity_id {kinds['entity_id']}"
    return Store(spark, f"{folder}/tables", {"state": key, "removed": f"batch bigint, {key}", "errors": f"batch bigint, source {kinds['source']}, error string"})


def sync_batch(tables: Store, batch: DataFrame, number: int, apply: Callable[[DataFrame, DataFrame], None] | None = None) -> None:
    """Take one batch of full snapshots (source, entity_id, error): one change with the number of the batch in its record.

    A source of the batch that has a row with an error has failed: it keeps its state, removes nothing and has a row
    in errors, while the others go on. A batch whose change is there has been taken and does nothing, so a batch that
    runs again after a failure removes the same ids, whatever came after it. ``apply`` (current rows, removed rows)
    comes before the change; a batch that failed between both gives it the same rows again.
    """
    if tables.noted("batch", number) is not None:
        return
    error = F.col("error") if "error" in batch.columns else F.lit(None).cast("string")
    rows = cut(batch.select("source", "entity_id", error.alias("error")).distinct())
    bad = rows.where("error is not null").groupBy("source").agg(F.min("error").alias("error"))
    now = rows.where("entity_id is not null and error is null").select("source", "entity_id").join(bad, "source", "left_anti")
    sources = rows.select("source").distinct().join(bad, "source", "left_anti")
    base = tables.for_writing()
    known = base.table("state")
    gone = cut(removed(known.join(sources, "source", "left_semi"), now))
    new = now.join(known, ["source", "entity_id"], "left_anti")
    if apply is not None:
        apply(now, gone)
    numbered = lambda df: df.withColumn("batch", F.lit(number).cast("bigint"))
    tables.commit(base, {"state": Change(new, [gone]), "removed": Change(numbered(gone)), "errors": Change(numbered(bad))}, batch=number)


def stream_sync(spark: SparkSession, feed: DataFrame, folder: str, interval: str | None = None, apply: Callable[[DataFrame, DataFrame], None] | None = None):
    """Start the query; ``feed`` streams rows (source, entity_id, error), each micro-batch being a full snapshot of its sources.

    A row without an entity_id names a source that has none. A batch that fails as a whole leaves the state as it was,
    its error in the errors table under a null source, and the loop goes on: Spark counts the batch as taken, so its
    rows come back with the sources' next snapshots. Without an interval all that is there is taken once.
    """
    tables = store(spark, folder, feed)

    def sync(batch: DataFrame, number: int) -> None:
        try:
            sync_batch(tables, batch, number, apply)
        except Exception as error:  # one bad cycle does not end the loop
            failed = spark.createDataFrame([(number, str(error)[:2000])], "batch bigint, error string").withColumn("source", F.lit(None).cast(tables_kind))
            tables.commit(tables.for_writing(), {"errors": Change(failed)}, batch=number)

    tables_kind = feed.schema["source"].dataType
    writer = feed.writeStream.foreachBatch(sync).option("checkpointLocation", f"{folder}/progress")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def run_once(spark: SparkSession, feed: DataFrame, apply: Callable[[DataFrame, DataFrame], None] | None = None, folder: str | None = None) -> DataFrame:
    """Take what is there and return the state after it; an empty feed leaves an empty state."""
    folder = folder or f"{shared_folder(spark)}/sync-{uuid.uuid4().hex}"
    stream_sync(spark, feed, folder, apply=apply).awaitTermination()
    return store(spark, folder, feed).snapshot().table("state")
