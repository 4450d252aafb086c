"""Edges and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.predicates import EXPANDED


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "type", "dst"])


def both_ways(edges: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(entity_id, direction, type, neighbour): out-edges (0) and in-edges (1)."""
    some = edges if types is None else edges.where(F.col("type").isin(*types))
    out = some.select(F.col("src").alias("entity_id"), F.lit(0).alias("direction"), "type", F.col("dst").alias("neighbour"))
    return out.union(some.select(F.col("dst").alias("entity_id"), F.lit(1).alias("direction"), "type", F.col("src").alias("neighbour")))


def neighbours(edges: DataFrame, entities: DataFrame, types: tuple[str, ...] = EXPANDED, limit: int | None = None) -> DataFrame:
    """(entity_id, neighbour, position): existing other documents next to each one, out before in, then by id."""
    near = both_ways(edges, types).where("entity_id <> neighbour").groupBy("entity_id", "neighbour").agg(F.min("direction").alias("direction"))
    there = near.join(entities.select(F.col("entity_id").alias("neighbour")), "neighbour", "left_semi")
    placed = there.withColumn("position", F.row_number().over(W.partitionBy("entity_id").orderBy("direction", "neighbour")))
    return (placed if limit is None else placed.where(F.col("position") <= limit)).select("entity_id", "neighbour", "position")
