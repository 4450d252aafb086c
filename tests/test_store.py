"""Tables that change together: damaged registers, two writers, syncs and batches that run again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statuta.operators import store as S
from statuta.operators.knowledge import COLUMNS, KnowledgeTables
from statuta.streaming import sync

SCHEMAS = {"a": "id bigint, name string", "b": "id bigint, n int"}


def opened(spark, tmp_path):
    return S.Store(spark, f"file://{tmp_path}/t", SCHEMAS)


def rows(spark, name, *values):
    return spark.createDataFrame(list(values), SCHEMAS[name])


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect())


def filled(spark, tmp_path):
    held = opened(spark, tmp_path)
    one = held.commit(held.for_writing(), {"a": S.Change(rows(spark, "a", (1, "x"), (2, "y"))), "b": S.Change(rows(spark, "b", (1, 10)))})
    held.commit(one, {"a": S.replacing(rows(spark, "a", (2, "new"), (3, "z")), "id"), "b": S.Change(gone=[rows(spark, "b", (1, 0)).select("id")])})
    return held


def test_changes_and_versions(spark, tmp_path, monkeypatch):
    empty = opened(spark, tmp_path).snapshot()
    assert empty.number == 0 and empty.table("a").count() == 0
    held = filled(spark, tmp_path)
    now = opened(spark, tmp_path).snapshot()
    assert ids(now.table("a"), "id", "name") == [(1, "x"), (2, "new"), (3, "z")] and now.table("b").count() == 0
    old = held.snapshot(at=1)
    assert ids(old.table("a"), "name") == ["x", "y"] and old.table("b").count() == 1
    monkeypatch.setattr(S, "MOST_PARTS", 2)
    after = held.commit(held.for_writing(), {"a": S.Change(rows(spark, "a", (9, "w")))})
    assert len(after.record["tables"]["a"]) == 1 and ids(held.snapshot().table("a"), "id") == [1, 2, 3, 9]


def test_of_two_writers_one_wins(spark, tmp_path):
    held, other = filled(spark, tmp_path), opened(spark, tmp_path)
    base = held.for_writing()
    other.commit(other.for_writing(), {"a": S.Change(rows(spark, "a", (7, "other")))})
    with pytest.raises(S.Conflict):
        held.commit(base, {"a": S.Change(rows(spark, "a", (8, "lost")))})
    assert 8 not in ids(held.snapshot().table("a"), "id")
    tried = []

    def change(at):
        if not tried:
            other.commit(other.for_writing(), {"a": S.Change(rows(spark, "a", (11, "first")))})
        tried.append(at.number)
        return {"a": S.Change(rows(spark, "a", (at.table("a").count(), "count")))}

    held.update(change)
    assert tried == [3, 4] and {11, 5} <= set(ids(held.snapshot().table("a"), "id"))


def test_a_change_that_was_not_published_is_not_seen(spark, tmp_path, monkeypatch):
    held = filled(spark, tmp_path)

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(S._Register, "publish", crash)
        held.commit(held.for_writing(), {"a": S.Change(rows(spark, "a", (50, "half"))), "b": S.Change(rows(spark, "b", (50, 1)))})
    again = opened(spark, tmp_path)
    assert again.snapshot().number == 2 and 50 not in ids(again.snapshot().table("a"), "id")
    again.commit(again.for_writing(), {"b": S.Change(rows(spark, "b", (51, 1)))})
    assert ids(again.snapshot().table("b"), "id") == [51] and again.snapshot().number == 3


def test_damage_reads_as_older_and_stops_writers(spark, tmp_path):
    filled(spark, tmp_path)
    commits = tmp_path / "t" / "commits"
    last = commits / f"{2:012d}.json"
    for damage in (b"no json", b"", b"\xff\xfe", b"[]"):
        last.write_bytes(damage)
        (commits / f".{last.name}.crc").unlink(missing_ok=True)
        held = opened(spark, tmp_path)
        assert held.snapshot().number == 1 and ids(held.snapshot().table("a"), "name") == ["x", "y"]
        with pytest.raises(S.Unreadable):
            held.for_writing()
    last.unlink()
    data = sorted((tmp_path / "t" / "data").iterdir())
    held = opened(spark, tmp_path)  # change 2's files look like an unpublished change; those of a third one would not
    assert held.for_writing().number == 1
    data[1].rename(data[1].with_name(f"{5:012d}-x"))
    with pytest.raises(S.Unreadable, match="missing"):
        opened(spark, tmp_path).for_writing()
    for x in commits.iterdir():
        x.unlink()
    commits.rmdir()
    held = opened(spark, tmp_path)
    assert held.snapshot().table("a").count() == 0
    with pytest.raises(S.Unreadable):
        held.for_writing()


def test_missing_files_and_other_columns(spark, tmp_path):
    filled(spark, tmp_path)
    for part in (tmp_path / "t" / "data").glob(f"{2:012d}-*/a-1/*"):
        part.unlink()
    held = opened(spark, tmp_path)
    assert held.snapshot().number == 1
    with pytest.raises(S.Unreadable):
        held.for_writing()
    assert S.Store(spark, f"file://{tmp_path}/t", {"a": "other string"}).snapshot().number == 0


def entity(i, title, body="b", kind="law", origin="s"):
    return (f"{kind}:{i}", kind, title, body, dt.date(2024, 1, 1), None, ["ALL"], "u", origin)


ENTITY = "entity_id string, type string, title string, body string, effective_date date, superseded_date date, allowed_depts array<string>, source string, origin string"
EDGE = "src string, type string, dst string"


def test_knowledge_tables(spark, tmp_path):
    held = KnowledgeTables(spark, f"file://{tmp_path}/k")
    assert held.entities().count() == held.neighbours().count() == held.postings().count() == 0
    docs = lambda *r: spark.createDataFrame(list(r), ENTITY)
    edges = spark.createDataFrame([("law:2", "cites", "law:1"), ("law:2", "supersedes", "law:1"), ("law:2", "cites", "law:9")], EDGE)
    held.put(docs(entity(1, "first"), entity(2, "two"), entity(1, "one")).coalesce(1), edges)
    assert ids(held.entities(), "title") == ["one", "two"]  # the last of equal ids
    held.put(docs(entity(1, "new")), edges)
    again = KnowledgeTables(spark, f"file://{tmp_path}/k")
    assert ids(again.entities(), "entity_id", "title") == [("law:1", "new"), ("law:2", "two")]
    assert again.edges().count() == 2 and again.neighbours().count() == 2 and ids(again.postings().where("entity_id = 'law:1'"), "term") == ["b", "new"]
    assert {r["chain_id"] for r in again.version_chains().collect()} == {"law:1"}
    before = again.store.snapshot().number
    again.delete(spark.createDataFrame([("law:1",), ("law:none",)], "entity_id string"))
    for df in (again.entities(), again.postings(), again.vectors()):
        assert set(ids(df, "entity_id")) == {"law:2"}
    assert again.edges().count() == 0 and again.entities(before).count() == 2


def tables(held):
    return [ids(held.read("entities").select(*COLUMNS, "origin", "fingerprint").withColumn("allowed_depts", F.array_join("allowed_depts", ",")).fillna("").withColumn("superseded_date", F.lit("")), *COLUMNS, "fingerprint"), ids(held.edges(), "src", "type", "dst"), ids(held.postings(), "term", "entity_id", "tf", "doc_len"), [(r[0], tuple(r[1]), tuple(r[2])) for r in held.vectors().orderBy("entity_id").collect()], ids(held.read("needles"), "src", "needle")]


def test_sync_equals_a_full_run(spark, tmp_path):
    docs = lambda *r: spark.createDataFrame(list(r), ENTITY)
    given = lambda *r: spark.createDataFrame(list(r), EDGE)
    cites = lambda n: f"이 사례는 「가법」 제{n}조 위반이다. 010-1234-5678"
    held = KnowledgeTables(spark, f"file://{tmp_path}/k")
    first = docs(entity(1, "가법 제1조(목적)"), entity(2, "가법 제2조(뜻)"), entity(1, "case", cites(1), "case", "t"), entity(2, "case", cites(3), "case", "t"), entity(3, "rev", cites(2), "review", "t"))
    report = {r["origin"]: r.asDict() for r in held.sync(first, given(("case:1", "violates", "law:1"))).collect()}
    assert report["t"]["added"] == 3 and report["t"]["ingested"] == 3 and report["t"]["ok"]
    assert ids(held.edges().where("type = 'cites'"), "src", "dst") == [("case:1", "law:1"), ("review:3", "law:2")]
    assert "010-1234" not in held.entities().where("entity_id = 'review:3'").first()["body"]
    # law 1 changes its article, law 3 comes and is cited by an old case, review 3 goes; only a relation of case 1 changes.
    second = docs(entity(1, "가법 제7조(목적)"), entity(2, "가법 제2조(뜻)"), entity(3, "가법 제3조(새)"), entity(1, "case", cites(1), "case", "t"), entity(2, "case", cites(3), "case", "t"))
    relations = given(("case:1", "violates", "law:2"))
    report = {r["origin"]: r.asDict() for r in held.sync(second, relations).collect()}
    assert (report["s"]["added"], report["s"]["changed"], report["s"]["removed"]) == (1, 1, 0)
    assert (report["t"]["added"], report["t"]["changed"], report["t"]["removed"]) == (0, 1, 1)
    fresh = KnowledgeTables(spark, f"file://{tmp_path}/fresh")
    fresh.sync(second, relations)
    assert tables(held) == tables(fresh)
    assert ids(held.edges(), "src", "type", "dst") == [("case:1", "violates", "law:2"), ("case:2", "cites", "law:3")]
    number = held.store.snapshot().number
    again = held.sync(second, relations).collect()
    assert held.store.snapshot().number == number and sum(r["added"] + r["changed"] + r["removed"] for r in again) == 0
    # A source that fails keeps what it has, one without documents loses all, one that is not asked stays.
    status = spark.createDataFrame([("s", "timeout"), ("t", None)], "origin string, fetch_error string")
    held.put(docs(entity(9, "put")).drop("origin"), given())
    report = {r["origin"]: r.asDict() for r in held.sync(second.limit(0), given(), status).collect()}
    assert not report["s"]["ok"] and report["s"]["errors"] == "timeout" and report["s"]["ingested"] == 0 and report["t"]["removed"] == 2
    assert ids(held.entities(), "entity_id") == ["law:1", "law:2", "law:3", "law:9"]
    request = spark.createDataFrame([(1, "가법 제3조", "IB", dt.date(2024, 6, 1), 3, None)], "query_id int, query string, dept string, as_of date, top_k int, source_types array<string>")
    assert [r["entity_id"] for r in held.retrieval(request).result.where("reason = 'citation_match'").collect()] == ["law:3"]


KIND = "source string, entity_id string, error string"


def test_a_batch_that_runs_again_removes_the_same(spark, tmp_path):
    batch = lambda *r: spark.createDataFrame(list(r), KIND)
    held = sync.store(spark, f"file://{tmp_path}/s", batch())
    gone = []
    apply = lambda now, removed: gone.append(ids(removed, "source", "entity_id"))
    batches = [batch(("a", "1", None), ("a", "2", None), ("b", "5", None)), batch(("a", "1", None), ("b", None, "timeout")), batch(("a", None, None), ("b", "5", None))]
    for number in (0, 1, 1, 0, 2, 2, 1):
        sync.sync_batch(held, batches[number], number, apply)
    assert gone == [[], [("a", "2")], [("a", "1")]]
    now = held.snapshot()
    assert ids(now.table("state"), "source", "entity_id") == [("b", "5")]
    assert ids(now.table("removed"), "batch", "source", "entity_id") == [(1, "a", "2"), (2, "a", "1")]
    assert ids(now.table("errors"), "batch", "source", "error") == [(1, "b", "timeout")]


def test_a_batch_that_stops_before_its_change_gives_the_same_rows_again(spark, tmp_path, monkeypatch):
    batch = lambda *r: spark.createDataFrame(list(r), KIND)
    held = sync.store(spark, f"file://{tmp_path}/s", batch())
    sync.sync_batch(held, batch(("a", "1", None), ("a", "2", None)), 0)
    seen = []

    def crash(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(S.Store, "commit", crash)
        sync.sync_batch(held, batch(("a", "1", None)), 1, lambda now, gone: seen.append(ids(gone, "entity_id")))
    sync.sync_batch(held, batch(("a", "1", None)), 1, lambda now, gone: seen.append(ids(gone, "entity_id")))
    assert seen == [["2"], ["2"]] and ids(held.snapshot().table("removed"), "batch", "entity_id") == [(1, "2")]


def test_sync_survives_a_bad_cycle(spark, tmp_path):
    kind = "source string, entity_id string"
    feed = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    spark.createDataFrame([], kind).write.json(f"file://{tmp_path}/in")
    assert sync.run_once(spark, feed(), folder=f"file://{tmp_path}/empty").count() == 0
    cycles = []

    def apply(now, gone):
        cycles.append(now.count())
        if len(cycles) == 2:
            raise ValueError("bad cycle")

    for part in ([("a", "1"), ("a", "2")], [("a", "9")], [("a", "2"), ("b", "3")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        found = sync.run_once(spark, feed(), apply, folder=f"file://{tmp_path}/state")
    assert ids(found, "source", "entity_id") == [("a", "2"), ("b", "3")]
    errors = sync.store(spark, f"file://{tmp_path}/state", feed()).snapshot().table("errors").collect()
    assert len(errors) == 1 and "bad cycle" in errors[0]["error"] and errors[0]["source"] is None
