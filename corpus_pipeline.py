"""From raw documents to packed training sequences: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``; the last
one returns the packed pieces. ``run`` writes each stage's result as Parquet into the shared folder and
reads it again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.lineage import shared_folder
from statuta.llm import langid, packing, secrets, simhash, substring_dedup
from statuta.llm.common import crc_fold
from statuta.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = tuple(c for c in COLUMNS if c != "text")
#: A document whose best language has a smaller mean probability than this is in none of the known ones.
LEAST_LANGUAGE_SCORE = 0.3
#: What no stage can express in SQL: learned models, XXH64 bit majorities and a tokenizer's ids.
ORACLE_SQL = None


def _documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with n_chars renewed where the text is another column."""
    held = df if text == "text" else df.withColumn("n_chars", F.length(text).cast("bigint")).withColumn("text", F.col(text))
    return held.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in a known language: those without letters, and those like no language, go.

    Judged by text, so repeated rows and rows without an id fare alike; null and empty texts go.
    """
    model = langid.fit(docs, F.coalesce(crc_fold(F.col("doc_id"), 3) != 1, F.lit(False)))
    texts = docs.select(F.struct(*OTHERS).alias("document"), "text")
    found = langid.predict(texts, model, id_col="document", with_text=True).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return found.select("document.*", "text").select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id, then the smallest text hash.

    Rows count by id and text, so an id with several unrelated texts keeps one row of each group that they
    belong to, and repeated rows are one. Rows without an id cannot be a group's smallest; they take no part
    and stay, one of each text. Null and empty texts are one group.
    """
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = simhash.near_duplicates(named.select(F.struct("doc_id", "h").alias("own"), "text"), id_col="own")
    found = groups.where(F.col("own") == F.col("component_id")).select("own.doc_id", "own.h").distinct()
    rest = F.struct("text", "lang", "source", "n_chars")
    kept = named.join(found, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.min(rest).alias("row")).select("doc_id", "row.*")
    return kept.select(*COLUMNS).union(docs.where(F.col("doc_id").isNull()).dropDuplicates(["text"]).select(*COLUMNS))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out words of windows that an earlier document has; documents that lose nothing keep their text as it is.

    Documents of which nothing is left go. Rows without an id, and rows that share one, are not earlier than
    each other; empty texts stay as they are.
    """
    texts = docs.select(F.struct(*OTHERS).alias("document"), F.col("doc_id"), "text")
    found = substring_dedup.remove_repeats(texts, carry="document", layout=True).where("n_words > n_removed or n_removed = 0")
    return _documents(found.select("document.*", "kept"), "kept")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in the place of every secret; all rows stay, repeated ones, null texts and null ids too."""
    found = secrets.scan(docs, secrets.fit(secrets.samples(spark, docs)), keep=["text", "lang", "source", "n_chars"])
    cleaned = found.withColumn("cleaned", F.when(F.size("spans") > 0, secrets.masked(F.col("secret_text"), F.col("spans"))).otherwise(F.col("text")))
    return _documents(cleaned, "cleaned")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequence and place; repeated rows and null ids are packed each, empty texts as the end id alone."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the folder of spark.checkpoint.dir."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
