"""How filters interact: what each removes, repeats and alone finds, in every order (operator 13).

A document removed by an ordered list of filters goes at the first one that it fails. With a mask matrix (0 where
a kind of document fails a filter, infinity where it passes) and a position matrix (the place of each filter in
each order, the inverse permutation), the step of its removal is their min-plus product. Spark counts the documents
of each kind; the product and the counts scattered by it are matrices of a size that depends on the filters alone.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_failures(text: Column) -> list[Column]:
    """Failures of filters A to D: few words, few distinct ones, many capitals, symbols."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of each kind there are; mask has bit k if filter k fails.

    Copies of a text anywhere in the table are found by its SHA-256; the one with the smallest id passes filter E, and
    so do rows that share that id and rows without one (a null id is neither smaller nor larger). Copies are counted
    before each shuffle, so a text that a third of all rows share is a few counts for each map task. An id counts as
    good or toxic if any of its labels says so; null labels and ids without one are neither.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum(F.when(fails, F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(text_failures(F.col("text"))))
    found = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("copy"), bits.alias("bits")).groupBy("doc_id", "part", "copy", "bits").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    marked = found.join(said, "doc_id", "left").fillna(False, ["good", "toxic"])
    kind = ["copy", "part", "bits", "good", "toxic"]
    lowest = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("lowest")
    kinds = marked.groupBy(*kind).agg(F.sum("n").alias("n"), lowest, F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    # A text's rows are at most four for each part by now.
    own = F.struct("part", "bits", "good", "toxic", "n", "lowest", "unnamed")
    of_text = kinds.groupBy("copy").agg(F.min("lowest.doc_id").alias("first_id"), F.collect_list(own).alias("kinds")).select("first_id", F.inline("kinds"))
    first = F.col("unnamed") + F.when(F.col("lowest.doc_id") == F.col("first_id"), F.col("lowest.n")).otherwise(0)
    split = of_text.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("bits").alias("mask"), first.alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - first).alias("n")))).alias("c"))
    return split.where("c.n > 0").groupBy("part", F.col("c.mask").alias("mask"), "good", "toxic").agg(F.sum("c.n").alias("n"))


def removal_ranks(n_filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orders (orders x filters), each filter's place in them (from 1), and the step at which each mask is removed.

    The last has (masks x orders) numbers; one more than there are filters stands for documents that stay.
    """
    orders = np.array(list(permutations(range(n_filters))))
    places = np.argsort(orders, axis=1) + 1.0
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    masks = np.where(fails == 1, 0.0, np.inf)
    ranks = (masks[:, None, :] + places[None, :, :]).min(axis=2)
    return orders, places.astype(int), np.where(np.isinf(ranks), n_filters + 1, ranks).astype(int)


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts for each part, order of the filters and step, from (part, mask, good, toxic, n).

    The product is made once a part, over the masks that there can be; a part has at most four rows for each mask.
    An empty table gives no rows.
    """
    n_filters = len(filters)
    orders, places, ranks = removal_ranks(n_filters)

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        mask, n = rows["mask"].to_numpy(), rows["n"].to_numpy()
        weight = np.zeros((1 << n_filters, 3), dtype=np.int64)
        for column, some in enumerate((True, rows["good"].to_numpy(), rows["toxic"].to_numpy())):
            np.add.at(weight[:, column], mask, n * some)
        gone = np.zeros((len(orders), n_filters + 1, 3), dtype=np.int64)
        np.add.at(gone, (np.arange(len(orders))[None, :], ranks - 1), weight[:, None, :])
        failing = np.array([weight[(np.arange(1 << n_filters) >> f) & 1 == 1, 0].sum() for f in range(n_filters)])
        removed = gone[:, :n_filters, 0]
        total = np.array([removed[np.arange(len(orders)), places[:, f] - 1].sum() for f in range(n_filters)])
        return pd.DataFrame({
            "part": rows["part"].iloc[0],
            "filter_order": np.repeat(["".join(filters[f] for f in o) for o in orders], n_filters),
            "step": np.tile(np.arange(1, n_filters + 1, dtype=np.int32), len(orders)),
            "kept": (weight[:, 0].sum() - removed.cumsum(axis=1)).ravel(),
            "removed": removed.ravel(),
            "redundant": (failing[orders] - removed).ravel(),
            "unique_fails": weight[1 << orders, 0].ravel(),
            "good_lost": gone[:, :n_filters, 1].ravel(),
            "toxic_lost": gone[:, :n_filters, 2].ravel(),
            "shapley": total[orders].ravel(),
        })

    return counted.groupBy("part").applyInPandas(of_part, SCHEMA)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of filters A to E over all rows of ``docs`` within each language.

    Texts count whole, null ones as empty; a null language is the part named by the empty string. Repeated rows count
    each. Other columns, whatever their names, are not read. With no documents there are no parts and no rows.
    """
    return interactions(cells(docs, labels))
