"""A user's fetch function as a data source: partitions, one that fails, a stream that goes on from its offset."""

import pytest
from pyspark.sql import functions as F

from statuta.operators.knowledge import KnowledgeTables
from statuta.sources import connector


def fetch_function():
    # made here, so that it travels to the workers by value
    def items(origin, start, end):
        if origin == "broken":
            yield {"id": "9", "title": "t", "body": "comes before it fails"}
            raise TimeoutError("no answer")
        have = [{"id": f"{origin}{k}", "title": f"가법 제{k}조(x)", "body": "본문", "relations": [["cites", "law:a0"]], "supersedes": f"law:old{k}"} for k in range(4)]
        have[3].pop("title")
        yield from have[start:end]

    return items


def test_batch_with_a_failing_partition(spark, tmp_path):
    name = connector.register(spark, fetch_function(), ["a", "b", "broken"])
    rows = spark.read.format(name).load()
    assert rows.rdd.getNumPartitions() == 3
    documents, relations, status, quarantine = connector.fetched(rows, "law", extend=lambda d: d.withColumn("title", F.concat(F.lit("[신] "), "title")))
    assert sorted(r["entity_id"] for r in documents.collect()) == ["law:a0", "law:a1", "law:a2", "law:b0", "law:b1", "law:b2"]
    assert {r["origin"]: r["fetch_error"] for r in status.collect()} == {"a": None, "b": None, "broken": "TimeoutError: no answer"}
    assert sorted((r["origin"], r["reason"]) for r in quarantine.collect()) == [("a", "missing title"), ("b", "missing title")]
    assert {r["type"] for r in relations.collect()} == {"cites", "supersedes"}
    own = connector.fetched(rows, "law", relations=lambda p: p.where("reason is null").select(F.concat(F.lit("law:"), "item.id").alias("src"), F.lit("related_to").alias("type"), F.lit("law:a1").alias("dst")))[1]
    assert {r["dst"] for r in own.collect()} == {"law:a1"}
    held = KnowledgeTables(spark, f"file://{tmp_path}/k")
    report = {r["origin"]: (r["added"], r["ok"]) for r in held.sync(documents, relations, status).collect()}
    assert report == {"a": (3, True), "b": (3, True), "broken": (0, False)}
    assert held.entities().where("title like '[신]%'").count() == 6 and held.edges().where("dst = 'law:a0'").count() == 6


def test_stream_goes_on_from_its_offset(spark, tmp_path):
    reach = tmp_path / "reach"

    def run(upto):
        reach.write_text(str(upto))
        path = str(reach)
        name = connector.register(spark, fetch_function(), ["a", "b"], latest=lambda origin: int(open(path).read()) - (origin == "b"))
        feed = spark.readStream.format(name).load()
        feed.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select(F.get_json_object("value", "$.id")).collect())

    assert run(2) == ["a0", "a1", "b0"]
    assert run(2) == ["a0", "a1", "b0"]
    assert run(3) == ["a0", "a1", "a2", "b0", "b1"]
    with pytest.raises(Exception, match="latest"):
        spark.readStream.format(connector.register(spark, fetch_function(), ["a"])).load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/none").start().awaitTermination()
