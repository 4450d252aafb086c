"""Version chains and the version in force on a date."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.lineage import cut
from statuta.functions.predicates import ALL

OLDEST = "0001-01-01"


def chains(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, chain_id): connected members of SUPERSEDES edges share the smallest id; others are alone.

    Label propagation with pointer jumping until nothing changes, in rounds that grow with the logarithm of the
    longest chain; edges to missing documents do not count. Cycles are harmless.
    """
    ids = entities.select("entity_id").distinct()
    linked = edges.where("type = 'supersedes' and src <> dst").select("src", "dst").join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
    both = cut(linked.select("src", "dst").union(linked.select("dst", "src")).distinct().toDF("a", "b"))
    label = cut(both.select(F.col("a").alias("entity_id")).distinct().withColumn("chain_id", F.col("entity_id")))
    while True:
        near = both.join(label, both["b"] == label["entity_id"]).groupBy("a").agg(F.min("chain_id").alias("low"))
        moved = label.join(near, label["entity_id"] == near["a"]).select("entity_id", F.least("chain_id", "low").alias("chain_id"), F.col("chain_id").alias("old"))
        jump = moved.select(F.col("entity_id").alias("via"), F.col("chain_id").alias("far"))
        now = cut(moved.join(jump, moved["chain_id"] == jump["via"], "left").select("entity_id", F.coalesce("far", "chain_id").alias("chain_id"), "old"))
        label = now.select("entity_id", "chain_id")
        if now.where("chain_id <> old").isEmpty():
            break
    return ids.join(label, "entity_id", "left").select("entity_id", F.coalesce("chain_id", "entity_id").alias("chain_id"))


def ordered(entities: DataFrame, version_map: DataFrame) -> DataFrame:
    """Members of each chain with their position, the oldest first."""
    order = W.partitionBy("chain_id").orderBy(F.coalesce("effective_date", F.lit(OLDEST).cast("date")), "entity_id")
    return entities.join(version_map, "entity_id").withColumn("position", F.row_number().over(order))


class _Sweep:
    """The versions of a chain that may still be in force, as days go by.

    Versions come by their first day and id. One that ends no later than an earlier one is never chosen before it and
    never after it, so it is not held; those that have ended are dropped. What is held is a queue of ever later ends.
    """

    def __init__(self):
        self.queue, self.begun, self.since = deque(), None, None

    def begin(self, day: int, end: int | None, entity_id) -> None:
        if self.since != day:
            self.begun, self.since = entity_id, day
        self._drop(day)
        last = float("inf") if end is None else end
        if last > day and (not self.queue or last > self.queue[-1][0]):
            self.queue.append((last, entity_id))

    def at(self, day: int):
        """The version valid on a day that began first, else the latest begun."""
        self._drop(day)
        return self.queue[0][1] if self.queue else self.begun

    def _drop(self, day: int) -> None:
        while self.queue and self.queue[0][0] <= day:
            self.queue.popleft()


def resolve(hits: DataFrame, entities: DataFrame, version_map: DataFrame) -> DataFrame:
    """Add resolved_id to rows (entity_id, as_of, ...): the chain's version valid then, else the latest begun before.

    Of several valid ones the first to begin counts, of equal days the smallest id. Hits on documents that do not
    exist, and dates before the first version, drop out. Versions and asked dates of a chain are one stream in the
    order of days, which a task reads once with little held, so work grows with their sum; a chain is resolved once
    for each date, however many hits it has.
    """
    placed = hits.join(version_map, "entity_id")
    day = lambda c: F.datediff(c, F.lit(OLDEST).cast("date"))
    start = F.coalesce(F.col("effective_date"), F.lit(OLDEST).cast("date"))
    none = F.lit(None)
    facts = entities.select("entity_id", start.alias("start"), "superseded_date").join(version_map, "entity_id").select("chain_id", day(F.col("start")).alias("day"), F.lit(0).alias("asked"), "entity_id", day(F.col("superseded_date")).alias("end"), none.cast("date").alias("as_of"))
    asked = placed.where("as_of is not null").select("chain_id", "as_of").distinct().select("chain_id", day(F.col("as_of")).alias("day"), F.lit(1).alias("asked"), none.cast(entities.schema["entity_id"].dataType).alias("entity_id"), none.cast("int").alias("end"), "as_of")
    kinds = {f.name: f.dataType.simpleString() for f in facts.schema}

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, state = object(), None
        for batch in batches:
            found, at = [], []
            for k, (own, day, is_asked, entity_id, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("chain_id", "day", "asked", "entity_id", "end")))):
                if own != chain:
                    chain, state = own, _Sweep()
                if not is_asked:
                    state.begin(day, end, entity_id)
                elif (resolved := state.at(day)) is not None:
                    found.append(resolved)
                    at.append(k)
            places = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("chain_id").take(places), batch.column("as_of").take(places), pa.array(found, batch.column("entity_id").type)], ["chain_id", "as_of", "resolved_id"])

    order = ["chain_id", "day", "asked", "entity_id"]
    stream = facts.unionByName(asked).repartition("chain_id").sortWithinPartitions(*order)
    chosen = stream.mapInArrow(sweep, f"chain_id {kinds['chain_id']}, as_of date, resolved_id {kinds['entity_id']}")
    return placed.join(chosen, ["chain_id", "as_of"]).drop("chain_id")


#: Levels of day blocks (of one day, two, four and so on) and the first day that they count from.
LEVELS, FIRST_DAY = 23, "0001-01-01"


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit(FIRST_DAY).cast("date"))


def _blocks(begin: Column, end: Column) -> Column:
    """The fewest blocks (level, block) that make up the days from begin to before end."""
    kind = "array<struct<level:int,block:bigint>>"
    start = F.struct(begin.cast("long").alias("lo"), end.cast("long").alias("hi"), F.array().cast(kind).alias("out"))

    def step(s: Column, level: Column) -> Column:
        odd_lo, odd_hi = (s["lo"] < s["hi"]) & (s["lo"] % 2 == 1), (s["lo"] < s["hi"]) & (s["hi"] % 2 == 1)
        one = lambda c, at: F.when(c, F.array(F.struct(level.alias("level"), at.alias("block"))).cast(kind)).otherwise(F.array().cast(kind))
        lo = F.when(odd_lo, s["lo"] + 1).otherwise(s["lo"])
        rest = odd_hi & (lo < s["hi"])
        hi = F.when(rest, s["hi"] - 1).otherwise(s["hi"])
        return F.struct(F.floor(lo / 2).alias("lo"), F.floor(hi / 2).alias("hi"), F.concat(s["out"], one(odd_lo, s["lo"]), one(rest, s["hi"] - 1)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["out"])


def counts_in_force(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """(type, query_id, n, first_id): documents of each type in force on a request's date and visible to its department.

    A document's days are made up of a few blocks of one, two, four ... days. Documents are counted by type,
    department and block first, which leaves a small table however many there are; a request then meets the
    blocks that its date lies in, one of each size, by equality. No document meets a request by itself.
    """
    last = 1 << LEVELS
    days = _blocks(F.coalesce(_day(F.col("effective_date")), F.lit(0)), F.coalesce(_day(F.col("superseded_date")), F.lit(last)))
    depts = F.when(F.array_contains("allowed_depts", ALL), F.array(F.lit(ALL))).otherwise(F.array_distinct("allowed_depts"))
    placed = entities.select("type", "entity_id", F.explode(depts).alias("dept"), days.alias("days")).select("type", "entity_id", "dept", F.explode("days").alias("b"))
    counted = placed.groupBy("type", "dept", "b.level", "b.block").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first_id"))
    asked = requests.select("query_id", F.explode(F.array_distinct(F.array("dept", F.lit(ALL)))).alias("dept"), _day(F.col("as_of")).cast("long").alias("day"))
    asked = asked.select("query_id", "dept", "day", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")).withColumn("block", F.floor(F.col("day") / F.pow(F.lit(2.0), F.col("level"))))
    return asked.join(counted, ["dept", "level", "block"]).groupBy("type", "query_id").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
