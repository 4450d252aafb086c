"""Citation check of stored answers, and the audit log."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A citation marker, and what replaces one that cannot be verified.
MARKER = r"\[\[CITE:([A-Za-z0-9_:.\-]+)\]\]"
UNVERIFIED = "[출처 미확인]"
FOOT = "\n\n---\n**참고 문서**\n"


def verify(answers: DataFrame, retrieved: DataFrame, entities: DataFrame, pattern: str = MARKER) -> DataFrame:
    """(answer_id, text, verified, rejected) of rows (answer_id, text).

    A marker is verified when its id was retrieved for the answer (rows answer_id, entity_id) and exists.
    Verified ids get numbers in the order of their first marker and are listed below the text; rejected ones
    are listed as often as they occur. A wider ``pattern`` (its first group is the id) may be given.
    """
    cited = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("pos", "entity_id"))
    known = retrieved.select("answer_id", "entity_id").distinct().join(entities.select("entity_id", "title"), "entity_id")
    checked = cited.join(known, ["answer_id", "entity_id"], "left").withColumn("ok", F.col("title").isNotNull())
    first = checked.where("ok").groupBy("answer_id", "entity_id").agg(F.min("pos").alias("first"))
    numbered = first.withColumn("n", F.row_number().over(W.partitionBy("answer_id").orderBy("first"))).drop("first")
    marks = checked.join(numbered, ["answer_id", "entity_id"], "left")
    mark = F.struct("pos", F.when(F.col("ok"), F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]"))).otherwise(F.lit(UNVERIFIED)).alias("shown"), "entity_id", "ok", "n", "title")
    listed = marks.groupBy("answer_id").agg(F.sort_array(F.collect_list(mark)).alias("marks"))
    joined = answers.join(listed, "answer_id", "left").withColumn("marks", F.coalesce("marks", F.array().cast(listed.schema["marks"].dataType)))
    pieces = F.split("text", pattern, -1)
    woven = F.array_join(F.flatten(F.transform(pieces, lambda p, i: F.array(p, F.coalesce(F.get("marks", i)["shown"], F.lit(""))))), "")
    # Of the marks of one id the first carries its line below the text.
    heads = F.filter("marks", lambda m, i: m["ok"] & ~F.exists(F.slice("marks", 1, i), lambda x: x["ok"] & (x["n"] == m["n"])))
    notes = F.array_join(F.transform(heads, lambda m: F.concat(F.lit("["), m["n"].cast("string"), F.lit("] "), m["title"], F.lit(" ("), m["entity_id"], F.lit(")"))), "\n")
    text = F.when(F.size(heads) > 0, F.concat(woven, F.lit(FOOT), notes)).otherwise(woven)
    return joined.select("answer_id", text.alias("text"), F.transform(heads, lambda m: m["entity_id"]).alias("verified"), F.transform(F.filter("marks", lambda m: ~m["ok"]), lambda m: m["entity_id"]).alias("rejected"))


AUDIT_SCHEMA = "timestamp string, user_id string, dept string, user_message string, tool_calls array<struct<name: string, result_ids: array<string>>>, verified_citations array<string>, rejected_citations array<string>, answer string"


def append_audit(records: DataFrame, folder: str) -> None:
    """Add records (the columns of AUDIT_SCHEMA) to the log, a JSON line each; nothing that is there changes."""
    _audit_columns(records).write.mode("append").json(f"{folder}/written")


def stream_audit(feed: DataFrame, folder: str, progress: str, name: str = "feed"):
    """Start a stream that appends arriving records to the log, each once.

    A batch has a folder of its own, named after the stream, so one that runs again after a restart replaces
    what it wrote before.
    """

    def append(batch: DataFrame, number: int) -> None:
        _audit_columns(batch).write.mode("overwrite").json(f"{folder}/{name}-{number}")

    return feed.writeStream.foreachBatch(append).option("checkpointLocation", progress).trigger(availableNow=True).start()


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the log; one that was never written to is empty."""
    try:
        return spark.read.schema(AUDIT_SCHEMA).option("recursiveFileLookup", True).json(folder)
    except PySparkException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA)


def _audit_columns(records: DataFrame) -> DataFrame:
    return records.select(*StructType.fromDDL(AUDIT_SCHEMA).names)


def audit_rollup(records: DataFrame) -> DataFrame:
    """Per department: records, tool calls, retrieved ids, verified and rejected citations."""
    total = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0))).cast("bigint")
    ids = F.aggregate("tool_calls", F.lit(0), lambda s, c: s + F.coalesce(F.size(c["result_ids"]), F.lit(0)))
    return records.groupBy("dept").agg(F.count(F.lit(1)).alias("records"), total("tool_calls").alias("calls"), F.sum(ids).cast("bigint").alias("ids"), total("verified_citations").alias("verified"), total("rejected_citations").alias("rejected"))
