"""Titles that contain a needle, without comparing every needle with every title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import DIGIT

#: Longest pieces of a title that are entered; shorter needles are pieces themselves.
PIECE = 3
#: A piece's titles are dealt to so many keys in the join, so that a piece of very many titles is no hot key.
SALTS = 16


def pieces(text: Column, size: int) -> Column:
    """Distinct stretches of ``size`` characters."""
    n = F.length(text) - (size - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def title_matches(needles: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of ``needles`` (needle, ...) with the entities (entity_id, type, title) whose title contains it, as it is written.

    A needle meets titles on its rarest piece: of needles of PIECE characters or more all stretches of that length,
    else the needle itself. Only pieces that needles have are counted. Each title with that piece is compared with the
    needle once, so work follows the titles that have the piece, and no needle needs more than one. Equal needles are
    looked up once, and their rows meet what was found in SALTS stretches, so that those of a needle that many have are
    not one task's. Empty and null needles, and null titles, find nothing.
    """
    asked = needles.select("needle").where("needle <> ''").distinct()
    size = F.least(F.length("needle"), F.lit(PIECE))
    own = F.when(size < PIECE, F.array("needle")).otherwise(pieces(F.col("needle"), PIECE))
    parts = asked.select("needle", F.explode(own).alias("piece"))
    entered = entities.where("title is not null").select("entity_id", "type", "title", F.explode(F.concat(*[pieces(F.col("title"), k + 1) for k in range(PIECE)])).alias("piece"))
    counts = entered.select("piece").join(parts.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("titles"))
    rarest = parts.join(counts, "piece", "left").groupBy("needle").agg(F.min_by("piece", F.struct(F.coalesce("titles", F.lit(0)), F.col("piece"))).alias("piece"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    found = rarest.select("needle", "piece", salts).join(entered.withColumn("salt", F.pmod(F.xxhash64("entity_id"), F.lit(SALTS)).cast("int")), ["piece", "salt"])
    held = found.where(F.col("title").contains(F.col("needle"))).select("needle", "salt", "entity_id", "type", "title")
    return needles.where("needle <> ''").withColumn("salt", salts).join(held, ["needle", "salt"]).drop("salt")


#: Characters of a law's name before an article that titles are looked up by, at most; longer needles meet on these.
NAME_LENGTH = 31


def article_matches(needles: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows of ``needles`` (needle, ...) with the entities whose title contains it, where each needle names an article.

    Both sides meet on an article with all that a needle has before it: each article of a title is entered with
    every end of the text before it, up to NAME_LENGTH characters, so a needle only meets titles that contain it
    (up to its branch number, which is compared afterwards).
    """
    article = rf"제{DIGIT}+조"
    hits = F.regexp_extract_all("title", F.lit(article), F.lit(0))
    # The text before the k-th article: everything up to it, other articles included.
    before = F.transform(hits, lambda h, k: F.call_function("substring_index", F.col("title"), h, F.size(F.filter(F.slice(hits, 1, k + 1), lambda x: x == h))))
    ends = F.flatten(F.zip_with(hits, before, lambda h, b: F.transform(F.sequence(F.lit(0), F.least(F.length(b), F.lit(NAME_LENGTH))), lambda n: F.concat(F.right(b, n), h))))
    titled = entities.select("entity_id", "type", "title", F.explode(F.array_distinct(ends)).alias("article"))
    first = F.regexp_extract("needle", article, 0)
    named = F.concat(F.right(F.call_function("substring_index", F.col("needle"), first, F.lit(1)), F.lit(NAME_LENGTH)), first)
    return needles.withColumn("article", named).join(titled, "article").where(F.col("title").contains(F.col("needle"))).drop("article")
