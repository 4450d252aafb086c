"""The engine's tables derived from the general test tables, by arithmetic that SQL can repeat.

``documents`` become versioned entities with typed edges, ``benchmark`` retrieval requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.predicates import ALL, TYPES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, type, title, body, effective_date, superseded_date, allowed_depts, source), three versions a family."""
    rows = read(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    rows = rows.selectExpr("*", "doc_id % 7 as t", "(doc_id div 21) * 7 + doc_id % 7 as family", "(doc_id div 7) % 3 as version")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("t") + 1).cast("int"))
    word = F.substring_index("text", " ", 1)  # split_part would cut the whole text into words
    title = F.concat(F.lit("Code"), F.expr("family div 14"), F.lit("법 제"), F.expr("family % 14 + 1"), F.lit("조("), word, F.lit(")"))
    cited = F.concat(F.lit(" 「Code"), F.expr("(family - t) div 14"), F.lit("법」 제"), F.expr("(family - t) % 14 + 1"), F.lit("조"))
    effective = F.expr("date_add(date'2020-01-01', cast(family % 200 + 400 * version as int))")
    superseded = F.expr("case when version < 2 then date_add(date'2020-01-01', cast(family % 200 + 400 * version + if(family % 5 = 0, 300, 400) as int)) end")
    depts = F.when(kind.isin("review", "precedent"), F.array(F.element_at(F.array(*map(F.lit, ("IB", "RETAIL", "WM"))), (F.col("doc_id") % 3 + 1).cast("int")))).otherwise(F.array(F.lit(ALL)))
    return rows.select(
        F.concat_ws(":", kind, F.col("doc_id").cast("string")).alias("entity_id"),
        kind.alias("type"),
        title.alias("title"),
        F.when(F.col("t") >= 2, F.concat("text", cited)).otherwise(F.col("text")).alias("body"),
        effective.alias("effective_date"),
        superseded.alias("superseded_date"),
        depts.alias("allowed_depts"),
        "source",
        "doc_id",
        "t",
        "version",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, type, dst): a version supersedes the one before; other types point at the law or rule of their family."""
    rows = entities(spark, sf_dir).select("doc_id", "t", "version", "entity_id")
    name = lambda k: F.concat(F.element_at(F.array(*map(F.lit, TYPES)), ((F.col("doc_id") - k) % 7 + 1).cast("int")), F.lit(":"), (F.col("doc_id") - k).cast("string"))
    chain = rows.where("version > 0").select(F.col("entity_id").alias("src"), F.lit("supersedes").alias("type"), name(7).alias("dst"))
    kinds = F.array(*map(F.lit, ("interprets", "violates", "cites", "answered_by", "cites")))
    back = F.array(*map(F.lit, (2, 3, 3, 4, 6)))
    at = (F.col("t") - 1).cast("int")
    other = rows.where("t >= 2").select(F.col("entity_id").alias("src"), F.element_at(kinds, at).alias("type"), name(F.element_at(back, at)).alias("dst"))
    return chain.union(other)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, dept, as_of, top_k, source_types) from the benchmark items; even ones name an article."""
    query = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" 제"), (F.col("item_id") % 14 + 1).cast("string"), F.lit("조"))).otherwise(F.lit("")))
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        query.alias("query"),
        F.element_at(F.array(*map(F.lit, ("IB", "RETAIL", "WM"))), (F.col("item_id") % 3 + 1).cast("int")).alias("dept"),
        F.expr("date_add(date'2020-06-01', cast(45 * item_id as int))").alias("as_of"),
        F.lit(6).alias("top_k"),
        F.lit(None).cast("array<string>").alias("source_types"),
    )
