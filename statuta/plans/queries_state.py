"""Queries of snapshots, sync, caches and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statuta.functions.lineage import shared_folder
from statuta.operators import lexical, state, vectors
from statuta.operators.knowledge import COLUMNS, TABLES, KnowledgeTables
from statuta.operators.store import Change, Store, replacing
from statuta.plans import sql as S
from statuta.plans.queries_text import AUTO, MASKED
from statuta.plans.register import Registry
from statuta.sources import adapter
from statuta.streaming import sync as stream

REGISTRY = Registry()
query = REGISTRY.query


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n=1")
def upsert_snapshot(spark, d):
    """Events of the first half as the old table, all others as updates of it."""
    rows = adapter.read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return state.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query(S.with_(S.ENT, S.EDGE) + "SELECT 'entities' AS name, count(*) AS n FROM ent WHERE doc_id%10<>0 UNION ALL SELECT 'edges', count(*) FROM edge WHERE src NOT IN (SELECT entity_id FROM ent WHERE doc_id%10=0) AND dst NOT IN (SELECT entity_id FROM ent WHERE doc_id%10=0)")
def delete_cascade(spark, d):
    rows = adapter.entities(spark, d)
    gone = rows.where("doc_id % 10 = 0").select("entity_id").union(rows.limit(0).select("entity_id"))
    count = lambda name, df: df.groupBy().count().select(F.lit(name).alias("name"), F.col("count").alias("n"))
    return count("entities", state.delete_rows(rows, gone, "entity_id")).union(count("edges", state.delete_rows(adapter.edges(spark, d), gone, "src", "dst")))


@query(S.with_(S.ENT, S.POSTINGS) + "SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences, count(DISTINCT term) AS terms FROM post")
def postings_roundtrip(spark, d):
    """The index is written as a table and read again."""
    found = lexical.postings(adapter.entities(spark, d), F.concat_ws("\n", "title", "body"))
    held = Store(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}", {"postings": TABLES["postings"]})
    held.commit(held.for_writing(), {"postings": Change(found)})
    return held.snapshot().table("postings").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("occurrences"), F.countDistinct("term").alias("terms"))


KNOWN = "kn AS (SELECT DISTINCT event_type AS source, user_id AS entity_id FROM events WHERE event_id%2=0), cu AS (SELECT DISTINCT event_type AS source, user_id AS entity_id FROM events WHERE event_id%3=0)"


def snapshots(spark, d):
    rows = adapter.read(spark, d, "events").select("event_id", F.col("event_type").alias("source"), F.col("user_id").alias("entity_id"))
    some = lambda n: rows.where(F.col("event_id") % n == 0).select("source", "entity_id").distinct()
    return some(2), some(3)


@query(S.with_(KNOWN) + "SELECT source, entity_id FROM kn EXCEPT SELECT source, entity_id FROM cu")
def removed_ids(spark, d):
    return state.removed(*snapshots(spark, d))


@query(
    S.with_(KNOWN)
    + ", st AS (SELECT DISTINCT event_type AS source, CASE WHEN length(event_type)%3=0 THEN 'fetch failed' END AS fe, CASE WHEN length(event_type)%4=0 THEN 'ingest failed' END AS ie FROM events)"
    + " SELECT source, CASE WHEN fe IS NULL AND ie IS NULL THEN (SELECT count(*) FROM cu WHERE cu.source=st.source) ELSE 0 END AS ingested, CASE WHEN fe IS NULL THEN (SELECT count(*) FROM kn WHERE kn.source=st.source AND entity_id NOT IN (SELECT entity_id FROM cu WHERE cu.source=st.source)) ELSE 0 END AS removed, concat_ws('; ',fe,ie) AS errors, fe IS NULL AND ie IS NULL AS ok FROM st"
)
def sync_report(spark, d):
    """One source fails to be fetched, another to be ingested; the rest goes on."""
    known, current = snapshots(spark, d)
    status = adapter.read(spark, d, "events").select(F.col("event_type").alias("source")).distinct()
    status = status.select("source", F.when(F.length("source") % 3 == 0, "fetch failed").alias("fetch_error"), F.when(F.length("source") % 4 == 0, "ingest failed").alias("ingest_error"))
    return state.sync_report(known, current, status)


@query(S.with_(S.ENT) + "SELECT entity_id, sha256('hash'||chr(10)||title||chr(10)||body) AS content_hash, CASE WHEN doc_id%3=0 THEN 'reuse' ELSE 'embed' END AS action FROM ent")
def embed_cache_plan(spark, d):
    """The cache has a third with the same text, a third with an older one, and nothing of the rest."""
    rows = adapter.entities(spark, d)
    old = rows.where("doc_id % 3 <> 2").withColumn("body", F.when(F.col("doc_id") % 3 == 1, F.concat("body", F.lit(" old"))).otherwise(F.col("body")))
    held = Store(spark, f"{shared_folder(spark)}/embedded-{uuid.uuid4().hex}", {"cache": "entity_id string, content_hash string"})
    base = held.for_writing()
    first = vectors.embed_plan(old, base.table("cache"), "hash")  # nothing is cached yet
    after = held.commit(base, {"cache": replacing(first.select("entity_id", "content_hash"), "entity_id")})
    return vectors.embed_plan(rows, after.table("cache"), "hash")


@query(S.with_(S.ENT) + "SELECT entity_id, [CAST(length(title||chr(10)||body) AS DOUBLE), CAST(len(string_split(title||chr(10)||body,' ')) AS DOUBLE)] AS embedding FROM ent")
def embed_user_model(spark, d):
    """A user's model over all documents, called inside the tasks with ten texts at a time."""
    texts = adapter.entities(spark, d).select("entity_id", F.concat_ws("\n", "title", "body").alias("text"))
    return vectors.embed_with(texts, lambda held: [[float(len(t)), float(len(t.split(" ")))] for t in held])


LINKED = """lk0 AS (SELECT src, type, dst FROM edge UNION SELECT src, type, dst FROM auto),
lk AS (SELECT * FROM lk0 WHERE src IN (SELECT entity_id FROM ent) AND dst IN (SELECT entity_id FROM ent))"""


@query(
    S.with_(S.ENT, S.EDGE, AUTO, LINKED, S.NEAR.replace("FROM edge", "FROM lk"))
    + "SELECT e.entity_id, e.title, count(n.neighbour) AS near, min(n.neighbour) AS first_near FROM ent e LEFT JOIN (SELECT entity_id, neighbour FROM near WHERE entity_id NOT IN (SELECT entity_id FROM ent WHERE doc_id%10=0) AND neighbour NOT IN (SELECT entity_id FROM ent WHERE doc_id%10=0)) n USING(entity_id) WHERE e.doc_id%10<>0 GROUP BY 1,2"
)
def knowledge_tables(spark, d):
    """Stored entities and edges: put in two steps, some deleted with their edges, then read with their neighbours."""
    held = KnowledgeTables(spark, f"{shared_folder(spark)}/knowledge-{uuid.uuid4().hex}")
    rows = adapter.entities(spark, d).select("doc_id", *[c for c in held.entities().columns])
    held.put(rows.where("doc_id % 2 = 0").drop("doc_id").withColumn("title", F.lit("old")), adapter.edges(spark, d))
    held.put(rows.drop("doc_id"), adapter.edges(spark, d))
    held.delete(rows.where("doc_id % 10 = 0").select("entity_id"))
    near = held.neighbours().groupBy("entity_id").agg(F.count(F.lit(1)).alias("near"), F.min("neighbour").alias("first_near"))
    return held.entities().join(near, "entity_id", "left").select("entity_id", "title", F.coalesce("near", F.lit(0)).alias("near"), "first_near")


#: Entities as they are stored, with personal data masked.
STORED = S.ENT.replace("\nent AS", "\nent1 AS") + f",\nent AS (SELECT * REPLACE (CASE WHEN type IN ('review','precedent') THEN {MASKED % 'body'} ELSE body END AS body) FROM ent1)"


@query(
    S.with_(STORED, S.EDGE, AUTO, LINKED, S.POSTINGS, S.embed("ev", "ent", "entity_id", "concat_ws(chr(10),title,body)"))
    + "SELECT e.entity_id, e.title, coalesce(p.n,0) AS terms, CAST(coalesce(p.tf,0) AS BIGINT) AS occurrences, coalesce(v.n,0) AS places, coalesce(o.n,0) AS out_edges, coalesce(i.n,0) AS in_edges FROM ent e"
    " LEFT JOIN (SELECT entity_id, count(*) AS n, sum(tf) AS tf FROM post GROUP BY 1) p USING(entity_id) LEFT JOIN (SELECT entity_id, count(*) AS n FROM ev GROUP BY 1) v USING(entity_id)"
    " LEFT JOIN (SELECT src AS entity_id, count(*) AS n FROM lk GROUP BY 1) o USING(entity_id) LEFT JOIN (SELECT dst AS entity_id, count(*) AS n FROM lk GROUP BY 1) i USING(entity_id)"
)
def delta_sync(spark, d):
    """Stored tables after two syncs, the second with some documents added, changed and removed; the SQL builds them anew.

    The first snapshot lacks every 20th document, has another title and body for every 30th, and has some that go.
    """
    held = KnowledgeTables(spark, f"{shared_folder(spark)}/delta-{uuid.uuid4().hex}")
    rows = adapter.entities(spark, d).withColumn("origin", F.col("type"))
    documents = rows.select(*COLUMNS, "origin")
    older = F.col("doc_id") % 30 == 1
    first = rows.where("doc_id % 20 <> 0").withColumn("title", F.when(older, F.concat(F.lit("예전 "), F.reverse("title"))).otherwise(F.col("title"))).withColumn("body", F.when(older, F.lit("「Code0법」 제3조")).otherwise(F.col("body")))
    extra = rows.where("doc_id % 25 = 2").withColumn("entity_id", F.concat("entity_id", F.lit("x"))).withColumn("title", F.concat("title", F.lit(" x")))
    given = adapter.edges(spark, d)
    held.sync(first.union(extra).select(*documents.columns), given.union(extra.select(F.col("entity_id").alias("src"), F.lit("cites").alias("type"), F.lit("law:0").alias("dst"))))
    held.sync(documents, given)
    each = lambda df, key, name, *more: df.groupBy(F.col(key).alias("entity_id")).agg(F.count(F.lit(1)).alias(name), *more)
    parts = [
        each(held.postings(), "entity_id", "terms", F.sum("tf").alias("occurrences")),
        held.vectors().select("entity_id", F.size("places").cast("bigint").alias("places")),
        each(held.edges(), "src", "out_edges"),
        each(held.edges(), "dst", "in_edges"),
    ]
    found = held.entities().select("entity_id", "title")
    for part in parts:
        found = found.join(part, "entity_id", "left")
    return found.fillna(0)


@query(
    S.with_(KNOWN)
    + "SELECT source, coalesce(removed,0) AS removed, known FROM (SELECT source, count(*) AS known FROM (SELECT * FROM cu WHERE length(source)%3<>0 UNION SELECT * FROM kn WHERE length(source)%3=0) GROUP BY 1)"
    " LEFT JOIN (SELECT source, count(*) AS removed FROM (SELECT * FROM kn WHERE length(source)%3<>0 EXCEPT SELECT * FROM cu) GROUP BY 1) USING(source)"
)
def replayed_batches(spark, d):
    """Two batches of snapshots, in the second of which one source fails; both run twice, as after a restart."""
    known, current = snapshots(spark, d)
    failed = F.length("source") % 3 == 0
    some = current.where(~failed).withColumn("error", F.lit(None).cast("string")).union(current.where(failed).select("source", F.lit(None).cast(current.schema["entity_id"].dataType).alias("entity_id"), F.lit("fetch failed").alias("error")).distinct())
    tables = stream.store(spark, f"{shared_folder(spark)}/replayed-{uuid.uuid4().hex}", known)
    for number, batch in ((0, known), (1, some), (0, known), (1, some)):
        stream.sync_batch(tables, batch, number)
    held = tables.snapshot()
    gone = held.table("removed").groupBy("source").agg(F.count(F.lit(1)).alias("removed"))
    kept = held.table("state").groupBy("source").agg(F.count(F.lit(1)).alias("known"))
    return kept.join(gone, "source", "left").select("source", F.coalesce("removed", F.lit(0)).alias("removed"), "known")


@query("SELECT DISTINCT event_type AS source, user_id AS entity_id FROM events")
def stream_sync(spark, d):
    """The event table as a stream of snapshots, taken once; what is known after it."""
    schema = adapter.read(spark, d, "events").schema
    feed = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")  # a file stream takes a folder or a pattern
    return stream.run_once(spark, feed.select(F.col("event_type").alias("source"), F.col("user_id").alias("entity_id")))
