"""Crawled items, one JSON text each, as documents; bad ones go to quarantine with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.korean import coerce_date
from statuta.functions.predicates import qualified_id
from statuta.functions.text import strip

SCHEMA = "id string, title string, body string, effective_date string, superseded_date string, source_url string, allowed_depts array<string>, relations array<array<string>>"
#: All edge types, and which field of an item stands for which.
EDGE_TYPES = ("supersedes", "amends", "interprets", "violates", "cites", "applies_to", "scoped_to", "related_to", "answered_by")
CONVENIENCE = {"law": "supersedes", "interpretation": "interprets", "case": "violates"}


def parse(items: DataFrame, json_col: str = "value") -> DataFrame:
    """The item's fields with reason: what is wrong with it, or null."""
    rows = items.select("*", F.from_json(json_col, SCHEMA).alias("item"))
    bad_date = lambda c: F.col(c).isNotNull() & (strip(F.col(c)) != "") & coerce_date(F.col(c)).isNull()
    missing = [F.when(F.col(f"item.{c}").isNull(), f"missing {c}") for c in ("id", "title", "body")]
    unknown = F.exists(F.coalesce("item.relations", F.array().cast("array<array<string>>")), lambda r: ~F.get(r, 0).isin(*EDGE_TYPES))
    aimless = F.exists(F.coalesce("item.relations", F.array().cast("array<array<string>>")), lambda r: F.coalesce(strip(F.get(r, 1)), F.lit("")) == "")
    reason = F.coalesce(*missing, F.when(bad_date("item.effective_date") | bad_date("item.superseded_date"), "bad date"), F.when(unknown, "unknown relation"), F.when(aimless, "relation without a target"))
    return rows.withColumn("reason", F.when(F.col("item").isNull(), "not an item").otherwise(reason))


def documents(parsed: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    good = parsed.where("reason is null")
    return good.select(
        qualified_id(F.lit(kind), F.col("item.id")).alias("entity_id"),
        F.lit(kind).alias("type"),
        F.col("item.title").alias("title"),
        F.col("item.body").alias("body"),
        coerce_date(F.col("item.effective_date")).alias("effective_date"),
        coerce_date(F.col("item.superseded_date")).alias("superseded_date"),
        F.coalesce("item.allowed_depts", F.array(F.lit("ALL"))).alias("allowed_depts"),
        F.coalesce("item.source_url", F.lit("")).alias("source"),
        *keep,
    )


def targets(json: Column, field: str) -> Column:
    """A field that is one id or a list of ids, as an array."""
    raw = F.get_json_object(json, f"$.{field}")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))


def convenience_edges(parsed: DataFrame, kind: str, json_col: str = "value") -> DataFrame:
    """(src, type, dst): an item's relations, then those of its kind's own field."""
    own = CONVENIENCE.get(kind)
    given = F.transform(F.coalesce("item.relations", F.array().cast("array<array<string>>")), lambda r: F.struct(F.get(r, 0).alias("type"), F.get(r, 1).alias("dst")))
    more = F.transform(targets(F.col(json_col), own), lambda t: F.struct(F.lit(own).alias("type"), t.alias("dst"))) if own else F.array().cast("array<struct<type:string,dst:string>>")
    rows = parsed.where("reason is null").select(qualified_id(F.lit(kind), F.col("item.id")).alias("src"), F.explode(F.concat(given, more)).alias("e"))
    return rows.select("src", "e.type", "e.dst")
