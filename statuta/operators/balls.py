"""Exact cosine search that skips blocks of documents by the triangle inequality of angles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.lineage import cut

#: A ball has about this many documents as long as there are fewer pivots than MOST_PIVOTS, and a ring of a ball, which
#: is a block, about RING_ROWS. Small balls are tight, and so skipped more often; a request is copied once for a block.
BALL_ROWS, RING_ROWS = 256, 1024
#: Pivots at most. They go to the tasks: a megabyte with 256 places each.
MOST_PIVOTS = 512
#: Angles are counted in cells of this width to find the rings; a ball has 805 cells at most, so the table of
#: all cells has under half a million rows.
CELL = 1 / 256
#: The blocks that a request meets first hold this many documents.
SEED_ROWS = 1024
#: Requests that are compared with a block at a time.
ASKED_SLICE = 512
#: Rows that are compared with the pivots at a time.
ROWS_SLICE = 1024
#: Scores are rounded to six digits before they are compared.
MARGIN = 2e-6
ALWAYS = 1 << 40
BLOCK = ["pivot", "ring", "chunk"]

Matrix = Callable[[pa.Table], np.ndarray]


def _turn(cosine: np.ndarray) -> np.ndarray:
    """Angles of cosines; a quarter turn where a vector is no number, since it is no hit anyway."""
    return np.nan_to_num(np.arccos(np.clip(cosine, -1, 1)), nan=np.pi / 2)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles to the pivots."""
    return _turn(vectors @ pivots.T)


def _fields(column: pa.Array) -> pa.Table:
    return pa.Table.from_arrays(column.flatten(), names=[f.name for f in column.type])


def _stretches(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of equal values in ``by``."""
    columns = [batch.column(c).to_numpy() for c in by]
    new = np.zeros(batch.num_rows, dtype=bool)
    for values in columns:
        new[1:] |= values[1:] != values[:-1]
    starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield tuple(int(v[a]) for v in columns), batch.slice(a, b - a)


@dataclass
class Balls:
    """Hits of requests (query_id, as_of, width, ...) among rows (entity_id, effective_date, superseded_date, ...).

    Both sides have places and weights, unit vectors without their zeros. Rows are dealt to the nearest of a sample of
    pivots, and each ball is cut into rings by the angle to its pivot. No row of a ring is closer to a request than the
    difference of their angles to the pivot, so a ring's best cosine is known before any of its rows is read. Each request
    first meets the rings that promise most, SEED_ROWS rows of them; its width-th score there is a threshold, and of the other
    rings it meets only those that may reach it and have a row in force on its date. Rows stay in their ring and go there
    once in each of the two passes, or not at all; requests come to them in slices.

    ``best(asked, rows, row_matrix)`` gives (query_id, entity_id, score, width) of the hits in a ring, at least the
    width best of each request with all that tie with the last one.
    """

    asked: DataFrame
    rows: DataFrame
    best: Callable[[pa.Table, pa.Table, np.ndarray], pa.Table]
    matrix: Matrix
    min_score: float
    ball_rows: int = BALL_ROWS
    ring_rows: int = RING_ROWS
    seed_rows: int = SEED_ROWS

    @cached_property
    def kept(self) -> DataFrame:
        return cut(self.rows)

    @cached_property
    def pivots(self) -> np.ndarray:
        """Vectors of documents, the first in the order of a hash of their id."""
        n = min(MOST_PIVOTS, max(1, -(-self.kept.count() // self.ball_rows)))
        found = self.kept.orderBy(F.xxhash64("entity_id"), "entity_id").limit(n).select("places", "weights").toArrow()
        return np.nan_to_num(self.matrix(found))

    @cached_property
    def in_balls(self) -> DataFrame:
        """Rows with their pivot, the angle to it and its cell."""
        matrix, pivots = self.matrix, self.pivots
        schema = T.StructType([*self.kept.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_SLICE):
                    part = batch.slice(at, ROWS_SLICE)
                    vectors = matrix(pa.Table.from_batches([part]))
                    own = np.nan_to_num(vectors @ pivots.T, nan=0.0).argmax(axis=1)
                    cosine = np.einsum("ij,ij->i", vectors, pivots[own])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(_turn(cosine))], [*part.schema.names, "pivot", "angle"])

        return self.kept.mapInArrow(run, schema).withColumn("cell", F.floor(F.col("angle") / CELL).cast("int"))

    @cached_property
    def in_rings(self) -> DataFrame:
        """Rows with their block: cells of a ball up to RING_ROWS are a ring; a cell with more is dealt to chunks."""
        counted = self.in_balls.groupBy("pivot", "cell").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("pivot").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        cells = counted.select("pivot", "cell", F.floor(before / self.ring_rows).cast("int").alias("ring"), F.ceil(F.col("n") / self.ring_rows).cast("int").alias("chunks"))
        # See CELL for the bound of this table.
        return self.in_balls.join(F.broadcast(cut(cells)), ["pivot", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("entity_id"), F.col("chunks")).cast("int")).drop("cell", "chunks")

    @cached_property
    def rings(self) -> DataFrame:
        """(pivot, ring, chunk, n, near, far, first, last): rows, angles and days in force of each block."""
        day = lambda c, none: F.coalesce(F.unix_date(c).cast("bigint"), F.lit(none))
        return cut(self.in_rings.groupBy(*BLOCK).agg(
            F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"),
            F.min(day("effective_date", -ALWAYS)).alias("first"), F.max(day("superseded_date", ALWAYS)).alias("last"),
        ))

    @cached_property
    def requests(self) -> DataFrame:
        return cut(self.asked)

    @cached_property
    def pairs(self) -> DataFrame:
        """(query_id, width, pivot, ring, chunk, n, most, seed): blocks with rows in force for a request, and their bound."""
        matrix, pivots = self.matrix, self.pivots
        own = self.requests.select("query_id", "width", F.unix_date("as_of").alias("day"), "places", "weights")
        kept = ["query_id", "width", "day"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ASKED_SLICE):
                    part = batch.slice(at, ASKED_SLICE)
                    angle = _angles(matrix(pa.Table.from_batches([part])), pivots)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(list(angle))], [*kept, "angles"])

        schema = T.StructType([*(own.schema[c] for c in kept), T.StructField("angles", T.ArrayType(T.DoubleType()))])
        each = own.mapInArrow(run, schema).select(*kept, F.posexplode("angles").alias("pivot", "angle"))
        gap = F.greatest(F.lit(0.0), F.col("angle") - F.col("far"), F.col("near") - F.col("angle"))
        met = each.join(self.rings, "pivot").where("first <= day and day < last").select("query_id", "width", *BLOCK, "n", (F.cos(gap) + MARGIN).alias("most"))
        order = W.partitionBy("query_id").orderBy(F.desc("most"), *BLOCK).rowsBetween(W.unboundedPreceding, -1)
        return met.withColumn("seed", F.coalesce(F.sum("n").over(order), F.lit(0)) < self.seed_rows)

    def _meet(self, pairs: DataFrame) -> DataFrame:
        """Hits of requests in the blocks that they are paired with."""
        names = {"rows": [c for c in self.rows.columns], "asked": [c for c in self.requests.columns]}
        rows = self.in_rings.join(pairs.select(*BLOCK).distinct(), BLOCK, "left_semi").select(*BLOCK, F.lit(0).alias("side"), F.struct(*names["rows"]).alias("rows"))
        asked = pairs.select("query_id", *BLOCK).join(self.requests, "query_id").select(*BLOCK, F.lit(1).alias("side"), F.struct(*names["asked"]).alias("asked"))
        both = rows.unionByName(asked, allowMissingColumns=True).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "side")
        best, matrix = self.best, self.matrix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held, joined = None, [], None
            for batch in batches:
                for (*key, side), part in _stretches(batch, [*BLOCK, "side"]):
                    if side == 0:
                        if key != block:
                            block, held = key, []
                        held.append(_fields(part.column("rows")))
                        joined = None
                        continue
                    if joined is None:
                        table = pa.concat_tables(held).combine_chunks()
                        joined = table, matrix(table)
                    for at in range(0, part.num_rows, ASKED_SLICE):
                        yield from best(_fields(part.slice(at, ASKED_SLICE).column("asked")), *joined).to_batches()

        kinds = [self.requests.schema["query_id"], self.rows.schema["entity_id"], T.StructField("score", T.DoubleType()), T.StructField("width", T.IntegerType())]
        return both.mapInArrow(run, T.StructType(kinds))

    @cached_property
    def first(self) -> DataFrame:
        return cut(self._meet(self.pairs.where("seed")))

    @cached_property
    def later(self) -> DataFrame:
        """The pairs of the second pass."""
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))
        least = self.first.withColumn("place", place).where("place = width").select("query_id", F.col("score").alias("least"))
        return self.pairs.where("not seed").join(least, "query_id", "left").where(F.col("most") >= F.coalesce("least", F.lit(self.min_score)))

    @cached_property
    def hits(self) -> DataFrame:
        """(query_id, entity_id, score, width): the width best of each request, and some more."""
        return self.first.union(self._meet(self.later))

    def met(self) -> DataFrame:
        """(query_id, met, total): documents that a request was compared with, of all."""
        total = self.rings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        some = self.pairs.where("seed").select("query_id", "n").union(self.later.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("met"))
        return self.requests.select("query_id").distinct().join(some, "query_id", "left").join(F.broadcast(total)).select("query_id", F.coalesce("met", F.lit(0)).alias("met"), "total")
