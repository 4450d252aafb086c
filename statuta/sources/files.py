"""Staged files as documents, whole or an article at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import korean
from statuta.functions.predicates import qualified_id
from statuta.sources import adapter

SUFFIXES = ("docx", "doc", "pdf")


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, with_content: bool = False) -> DataFrame:
    """(path, length[, content]) of the files under a folder with one of the suffixes; a missing folder has none.

    Contents are read only if asked for.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
    try:
        found = reader.load(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    return found.select("path", "length", *["content"] * with_content)


def texts(found: DataFrame) -> DataFrame:
    """(path, text, error) of scanned files with their content; what is no valid UTF-8 has an error instead of a text."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return found.select("path", F.when(good, F.col("content").cast("string")).alias("text"), F.when(~good, F.lit("not a UTF-8 text")).alias("error"))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): rule files made of the documents, one article a line, with spaces and digits of several scripts."""
    rows = adapter.read(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    word = F.split_part(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("\n"), F.lit(1))
    folder = F.element_at(F.array(*map(F.lit, ("IB/", "RETAIL/", "", "WM/sub/"))), (F.col("doc_id") % 4 + 1).cast("int"))
    plain = F.regexp_replace(word, "/", "")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat((F.col("doc_id") % 50 + 1).cast("string"), F.lit(". "), plain)).otherwise(F.concat(F.lit("규정 "), plain, F.lit(" "), F.col("doc_id").cast("string")))
    number = lambda n, k: (F.col("doc_id") % n + k).cast("string")
    first = F.concat(F.when(F.col("doc_id") % 2 == 0, "\u3000-----\u2003\n").otherwise(F.lit("")), F.lit("\u00a0규정 "), F.col("doc_id").cast("string"), F.lit(" "), word, F.when(F.col("doc_id") % 5 == 1, "\u2028둘째 줄").otherwise(F.lit("\u3000")))
    head = F.concat(first, F.lit("\n제정 "), number(20, 2000), F.lit("."), number(13, 1), F.lit("."), number(28, 1), F.lit(" 개정\u00a0２０２1-"), number(12, 1), F.lit("-"), number(9, 1), F.lit("\n"))
    lines = F.split("text", "\n")
    topic = F.array(*map(F.lit, TOPICS))
    some = lambda when, what: F.when(when, what).otherwise(F.lit(""))
    article = lambda x, i: F.concat(F.lit("제"), some(i % 4 == 0, "\u00a0"), (i + 1).cast("string"), F.lit("조"), some((i + 1) % 5 == 0, "의\u2003２"), some(i % 3 == 0, "\u3000"), F.lit("("), F.element_at(topic, i % len(TOPICS) + 1), F.lit("\u00a0) "), x)
    body = F.array_join(F.when(F.col("doc_id") % 7 == 3, lines).otherwise(F.transform(lines, article)), "\n")
    tail = some(F.col("doc_id") % 3 == 1, F.concat(F.when(F.col("doc_id") % 2 == 0, "\n부\u00a0칙").otherwise(F.lit("\n부칙")), F.lit("\n이 규정은 공포한 날부터 시행한다.")))
    return rows.select("doc_id", F.concat(folder, name, F.lit(".docx")).alias("path"), F.concat(head, body, tail).alias("text"))


#: Headings of the made-up articles, so that every kind of checklist occurs.
TOPICS = ("목적", "손해배상", "계약해지", "관할법원", "비밀유지", "면책", "업무위탁", "정의")


def file_documents(files: DataFrame, kind: str) -> DataFrame:
    """A document a file: id, title, body, latest revision as effective date, departments from the folder."""
    stem = korean.file_stem(F.col("path"))
    return files.select(
        qualified_id(F.lit(kind), korean.external_id(stem)).alias("entity_id"),
        F.lit(kind).alias("type"),
        korean.doc_title(F.col("text")).alias("title"),
        F.col("text").alias("body"),
        korean.latest_revision(F.col("text")).alias("effective_date"),
        korean.dept_from_path(F.col("path")).alias("allowed_depts"),
        F.col("path").alias("source"),
    )


def article_documents(files: DataFrame, kind: str = "regulation") -> DataFrame:
    """A document an article, numbered within its file; files without articles stay whole."""
    docs = file_documents(files, kind).withColumn("articles", korean.split_articles(F.col("body")))
    parts = docs.select("*", F.posexplode_outer("articles").alias("n", "article"))
    return parts.select(
        F.when(F.col("n").isNull(), F.col("entity_id")).otherwise(F.concat("entity_id", F.lit("-"), (F.col("n") + 1).cast("string"))).alias("entity_id"),
        "type",
        F.when(F.col("n").isNull(), F.col("title")).otherwise(F.concat("title", F.lit(" "), "article.label")).alias("title"),
        F.coalesce("article.body", "body").alias("body"),
        "effective_date",
        "allowed_depts",
        "source",
    )
