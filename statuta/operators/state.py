"""Snapshots of tables: upsert, cascading deletes, and what vanished from a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *newest: str) -> DataFrame:
    """The last row of each key in the order of ``newest``."""
    order = W.partitionBy(key).orderBy(*[F.desc(c) for c in newest])
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def upsert(old: DataFrame, new: DataFrame, key: str, *newest: str) -> DataFrame:
    """Old and new rows together, the last of each key."""
    return latest(old.unionByName(new), key, *newest)


def duplicates(rows: DataFrame, key: str, newest: str) -> DataFrame:
    """(key, n, kept, row): keys that occur more than once, how often, and which row ``latest`` keeps."""
    last = F.max_by(F.struct(*rows.columns), F.col(newest))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(newest).alias("kept"), last.alias("row")).where("n > 1")


def delete_rows(table: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """The table without rows that name a deleted id in one of the columns; ids that are not there do nothing."""
    for column in columns:
        table = table.join(gone.select(F.col("entity_id").alias(column)), column, "left_anti")
    return table


def removed(known: DataFrame, current: DataFrame) -> DataFrame:
    """(source, entity_id) that a source had before and does not have now."""
    return known.select("source", "entity_id").distinct().join(current.select("source", "entity_id"), ["source", "entity_id"], "left_anti")


def sync_report(known: DataFrame, current: DataFrame, status: DataFrame) -> DataFrame:
    """(source, ingested, removed, errors, ok) of every source in ``status`` (source, fetch_error, ingest_error).

    A source that could not be fetched removes nothing; one that could not be ingested has removed already.
    A first run removes nothing, since nothing is known.
    """
    gone = removed(known, current).groupBy("source").agg(F.count(F.lit(1)).alias("gone"))
    came = current.groupBy("source").agg(F.countDistinct("entity_id").alias("came"))
    rows = status.join(gone, "source", "left").join(came, "source", "left")
    fetched, errors = F.col("fetch_error").isNull(), F.array_compact(F.array("fetch_error", "ingest_error"))
    return rows.select(
        "source",
        F.when(fetched & F.col("ingest_error").isNull(), F.coalesce("came", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("ingested"),
        F.when(fetched, F.coalesce("gone", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("removed"),
        F.array_join(errors, "; ").alias("errors"),
        (F.size(errors) == 0).alias("ok"),
    )


def next_state(known: DataFrame, current: DataFrame, report: DataFrame) -> DataFrame:
    """What is known after a sync: the current ids of sources that went well, the old ones of others."""
    good = report.where("ok").select("source")
    return current.select("source", "entity_id").distinct().join(good, "source", "left_semi").union(known.select("source", "entity_id").join(good, "source", "left_anti"))
