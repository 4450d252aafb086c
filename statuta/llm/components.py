"""Connected components over an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import cut

#: A node's edges are dealt to this many keys in a join, so that a node with very many is no hot key.
SALTS = 32


def _dealt_join(edges: DataFrame, moves: DataFrame, how: str) -> DataFrame:
    """Join edges (u, v) with moves (u, m), of which there are few, by u and a salt of v."""
    left = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    right = moves.select("u", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return left.join(right, ["u", "salt"], how)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours with the smallest of its neighbours and itself.

    Only nodes with a smaller neighbour move anything; the root of a star stays as it is.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moves = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).where("m < u and most > u")
    return _dealt_join(both.where("v > u"), moves, "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours with the smallest of these.

    Only nodes with several smaller neighbours move anything.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
    moved = _dealt_join(down, low.where("most > m"), "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has comparable columns u and v. Null ends and self links are ignored; repeated and reversed
    edges are harmless. An empty table gives an empty one. Rounds grow with the logarithm of the longest
    path; each round works on grouped, distinct edges and is cut by a checkpoint. Minima are combined before
    the shuffle, and the edges of a node that has very many are dealt to several keys.
    """
    now = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)).distinct())
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
