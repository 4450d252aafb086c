"""From source documents to entities and typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.korean import citation_needle, law_citations
from statuta.functions.text import mask_pii
from statuta.operators.graph import distinct_edges
from statuta.operators.titles import article_matches

#: Types whose bodies are masked, the type that cites nothing, and those that can be cited.
MASKED, UNSCANNED, CITABLE = ("review", "precedent"), "law", ("law", "regulation")


def ingest_entities(docs: DataFrame) -> DataFrame:
    """Documents with personal data masked in the bodies of the types that hold internal matters."""
    return docs.withColumn("body", F.when(F.col("type").isin(*MASKED), mask_pii(F.col("body"))).otherwise(F.col("body")))


def citation_needles(docs: DataFrame) -> DataFrame:
    """(src, needle): what documents cite, as it would stand in a title; laws cite nothing."""
    scanned = docs.where(F.col("type") != UNSCANNED).select("entity_id", F.concat_ws("\n", "title", "body").alias("text"))
    return law_citations(scanned, F.col("text"), "entity_id").select(F.col("entity_id").alias("src"), citation_needle().alias("needle")).distinct()


def cited_titles(needles: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, type, dst): laws and rules whose title has a needle."""
    found = article_matches(needles, docs).where(F.col("type").isin(*CITABLE))
    return found.select("src", F.lit("cites").alias("type"), F.col("entity_id").alias("dst")).distinct()


def auto_citations(docs: DataFrame) -> DataFrame:
    """(src, type, dst): laws and rules whose title has the name and article that a document cites."""
    return cited_titles(citation_needles(docs), docs)


def ingest_edges(docs: DataFrame, explicit: DataFrame) -> DataFrame:
    return distinct_edges(explicit.select("src", "type", "dst").union(auto_citations(docs)))
