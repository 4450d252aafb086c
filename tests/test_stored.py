"""Stored tables, scans, the audit log and the sync loop: missing, damaged and repeated things."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statuta.functions import lineage
from statuta.operators import guard, state, versions
from statuta.sources import crawl, files


def test_scan_of_missing_folder_and_bad_files(spark, tmp_path):
    assert files.scan(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "IB").mkdir()
    (tmp_path / "IB" / "1. a.txt").write_text("규정\n제1조(목적) x")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "other.bin").write_bytes(b"x")
    found = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in files.texts(files.scan(spark, f"file://{tmp_path}", ("txt",), with_content=True)).collect()}
    assert found["bad.txt"] == (None, "not a UTF-8 text") and found["1.%20a.txt" if "1.%20a.txt" in found else "1. a.txt"][1] is None and len(found) == 2


def test_audit_log_only_grows(spark, tmp_path):
    folder = f"file://{tmp_path}/audit"
    assert guard.read_audit(spark, folder).count() == 0
    row = ("2024-01-01", "u", "IB", "질문", [("search", ["a", "b"])], ["a"], [], "답")
    record = spark.createDataFrame([row], guard.AUDIT_SCHEMA)
    guard.append_audit(record, folder)
    guard.append_audit(record, folder)
    record.write.json(f"file://{tmp_path}/arrived")
    for _ in range(2):  # a restart adds nothing again
        feed = spark.readStream.schema(guard.AUDIT_SCHEMA).json(f"file://{tmp_path}/arrived")
        guard.stream_audit(feed, folder, f"file://{tmp_path}/progress").awaitTermination()
    found = guard.audit_rollup(guard.read_audit(spark, folder)).first()
    assert (found["records"], found["calls"], found["ids"], found["verified"], found["rejected"]) == (3, 3, 6, 3, 0)


def test_counts_in_force_at_the_edges(spark):
    day = dt.date
    rows = [("a", "law", None, None, ["ALL"]), ("b", "law", day(2024, 1, 5), day(2024, 1, 9), ["IB", "IB"]), ("c", "law", day(2024, 1, 9), None, ["ALL", "IB"]), ("d", "faq", day(2024, 1, 9), day(2024, 1, 9), ["ALL"])]
    entities = spark.createDataFrame(rows, "entity_id string, type string, effective_date date, superseded_date date, allowed_depts array<string>")
    asked = [(k, "IB", day(2024, 1, d)) for k, d in enumerate((4, 5, 8, 9, 31))] + [(9, "WM", day(2024, 1, 6))]
    found = {r["query_id"]: (r["n"], r["first_id"]) for r in versions.counts_in_force(spark.createDataFrame(asked, "query_id int, dept string, as_of date"), entities).collect()}
    assert found == {0: (1, "a"), 1: (2, "a"), 2: (2, "a"), 3: (2, "a"), 4: (2, "a"), 9: (1, "a")}


def test_relation_without_a_target(spark):
    item = '{"id": "1", "title": "t", "body": "b", "relations": [["cites", null]]}'
    found = crawl.parse(spark.createDataFrame([(item,)], "value string")).first()
    assert found["reason"] == "relation without a target"


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://x:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        lineage.shared_folder(Cluster)
    assert lineage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_latest_and_duplicates(spark):
    rows = spark.createDataFrame([("a", "x/1"), ("a", "y/1"), ("b", "z")], "id string, path string").withColumn("extra", F.lit(1))
    assert {r["id"]: r["path"] for r in state.latest(rows, "id", "path").collect()} == {"a": "y/1", "b": "z"}
    found = state.duplicates(rows, "id", "path").collect()
    assert [(r["id"], r["n"], r["kept"], r["row"]["path"]) for r in found] == [("a", 2, "y/1", "y/1")]
