"""Documents with their postings, vectors and edges as stored tables that change together."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.lineage import cut
from statuta.functions.predicates import EXPANDED
from statuta.operators import graph, lexical, state, vectors, versions
from statuta.operators.store import Change, Snapshot, Store, replacing

ENTITIES = "entity_id string, type string, title string, body string, effective_date date, superseded_date date, allowed_depts array<string>, source string"
EDGES = "src string, type string, dst string"
TABLES = {
    "entities": f"{ENTITIES}, origin string, fingerprint string",
    "relations": EDGES,
    "needles": "src string, needle string",
    "citations": EDGES,
    "postings": "term string, entity_id string, tf bigint, doc_len bigint",
    "vectors": "entity_id string, places array<int>, weights array<double>",
}
#: Origins up to which a list of them goes to all tasks.
MOST_ORIGINS = 100_000
COLUMNS = tuple(c.split(" ")[0] for c in ENTITIES.split(", "))


def _text() -> Column:
    return F.concat_ws("\n", "title", "body")


class KnowledgeTables:
    """The stored tables of a folder that all machines share. Every change is one commit over all of them.

    Readers take the newest whole change or an older one by its number; a damaged register reads as an older state or
    as empty tables, but stops a writer. Edges show while both their ends exist. ``embed`` turns documents
    (entity_id, title, body, ...) into rows of vectors; by default they are hashed.
    """

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[DataFrame], DataFrame] | None = None):
        self.store = Store(spark, folder, TABLES)
        self.embed = embed or (lambda docs: vectors.hash_vectors(docs, _text(), "entity_id"))

    def read(self, name: str, at: int | None = None) -> DataFrame:
        return self.store.snapshot(at).table(name)

    def entities(self, at: int | None = None) -> DataFrame:
        return self.read("entities", at).select(*COLUMNS)

    def edges(self, at: int | None = None) -> DataFrame:
        """Given relations and found citations between documents that exist, each once."""
        held = self.store.snapshot(at)
        there = held.table("entities").select("entity_id")
        every = graph.distinct_edges(held.table("relations").union(held.table("citations")))
        for end in ("src", "dst"):
            every = every.join(there.withColumnRenamed("entity_id", end), end, "left_semi")
        return every.select("src", "type", "dst")

    def postings(self, at: int | None = None) -> DataFrame:
        return self.read("postings", at)

    def vectors(self, at: int | None = None) -> DataFrame:
        return self.read("vectors", at)

    def put(self, entities: DataFrame, edges: DataFrame, newest: tuple[str, ...] = ()) -> Snapshot:
        """Add or replace documents, and add edges that are not there; nothing else goes.

        Of rows with one id the last in the order of the columns ``newest`` counts, by default in that of the rows.
        """
        rows = entities.withColumn("_order", F.monotonically_increasing_id())
        last = cut(state.latest(rows, "entity_id", *newest, "_order").select(*COLUMNS).withColumn("origin", F.lit("")).withColumn("fingerprint", F.lit("")))

        def change(base: Snapshot) -> dict[str, Change]:
            new = graph.distinct_edges(edges.select("src", "type", "dst")).join(base.table("relations"), ["src", "type", "dst"], "left_anti")
            return {**self._documents(last), "relations": Change(new), **self._citations(base, last, last.select("entity_id"))}

        return self.store.update(change)

    def delete(self, ids: DataFrame) -> Snapshot:
        """Delete documents (rows entity_id) from all tables, and all edges from and to them; ids that are not there do nothing."""
        gone = cut(ids.select("entity_id").distinct())
        ends = [gone.withColumnRenamed("entity_id", end) for end in ("src", "dst")]
        by_id = {name: Change(gone=[gone]) for name in ("entities", "postings", "vectors")}
        return self.store.update(lambda base: {**by_id, "relations": Change(gone=ends), "citations": Change(gone=ends), "needles": Change(gone=ends[:1])})

    def sync(self, documents: DataFrame, relations: DataFrame, status: DataFrame | None = None) -> DataFrame:
        """Bring all tables up to date with full snapshots of the sources; (origin, ingested, added, changed, removed, errors, ok).

        ``documents`` has the columns of entities and origin, the source that each comes from; of rows with one id the
        last in the order of origin and content counts. A source without documents is known by its row in ``status``;
        documents of origins that occur in neither stay as they are. Only added and changed documents are masked, cut into words,
        embedded and searched for citations; what an origin has no longer goes from all tables. An origin with a
        fetch_error in ``status`` (origin, fetch_error) keeps what it had, while others go on. Citations are looked up
        both ways, new documents in old titles and old documents in new titles, so the tables are those of a full run
        over the same documents. A second run with the same documents changes nothing.
        """
        from statuta.plans.ingest import ingest_entities

        none = documents.sparkSession.createDataFrame([], "origin string, fetch_error string")
        asked = (none if status is None else status.select("origin", "fetch_error")).unionByName(documents.select("origin"), allowMissingColumns=True)
        marks = cut(asked.groupBy("origin").agg(F.min("fetch_error").alias("fetch_error")))
        bad = marks.where("fetch_error is not null")
        if marks.count() <= MOST_ORIGINS:  # else documents, texts and all, are dealt to as many tasks as there are origins
            bad = F.broadcast(bad)
        given = relations.groupBy("src").agg(F.sort_array(F.collect_set(F.struct("type", "dst"))).alias("given"))
        rows = ingest_entities(documents.join(bad, "origin", "left_anti")).join(given, F.col("entity_id") == F.col("src"), "left")
        content = F.to_json(F.struct(*COLUMNS, "given"), {"ignoreNullFields": "false"})
        hashed = rows.select(*COLUMNS, "origin", F.coalesce("given", F.array().cast("array<struct<type:string,dst:string>>")).alias("given"), F.sha2(content, 256).alias("fingerprint"))
        incoming = cut(state.latest(hashed, "entity_id", "origin", "fingerprint"))
        found: dict[str, DataFrame] = {}

        def change(base: Snapshot) -> dict[str, Change] | None:
            known = base.table("entities").select("entity_id", F.col("origin").alias("known_origin"), F.col("fingerprint").alias("known"))
            both = incoming.select("entity_id", "origin", "fingerprint").join(known, "entity_id", "full").join(marks.select(F.col("origin").alias("known_origin"), F.col("fetch_error").isNull().alias("taken")), "known_origin", "left")
            action = F.when(F.col("known_origin").isNull(), "added").when(F.col("fingerprint") == F.col("known"), "same").when(F.col("fingerprint").isNotNull(), "changed").when(F.col("taken"), "removed").otherwise("same")
            diff = found["diff"] = cut(both.select("entity_id", F.coalesce("origin", "known_origin").alias("origin"), action.alias("action")))
            moved = diff.where("action <> 'same'")
            if moved.isEmpty():
                return None
            fresh = cut(incoming.join(moved.where("action <> 'removed'").select("entity_id"), "entity_id", "left_semi"))
            gone = cut(moved.where("action <> 'added'").select("entity_id"))
            source = [gone.withColumnRenamed("entity_id", "src")]
            own = fresh.select(F.col("entity_id").alias("src"), F.inline("given")).select("src", "type", "dst")
            changes = self._documents(fresh) | {"relations": Change(own, source)} | self._citations(base, fresh, gone)
            for name in ("entities", "postings", "vectors"):
                changes[name].gone = [gone]
            return changes

        self.store.update(change)
        counts = found["diff"].groupBy("origin").agg(*[F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ("added", "changed", "removed", "same")])
        report = marks.join(counts, "origin", "left").fillna(0)
        ok = F.col("fetch_error").isNull()
        ingested = F.when(ok, F.col("added") + F.col("changed") + F.col("same")).otherwise(F.lit(0).cast("bigint"))
        return report.select("origin", ingested.alias("ingested"), "added", "changed", "removed", F.coalesce("fetch_error", F.lit("")).alias("errors"), ok.alias("ok"))

    def _documents(self, fresh: DataFrame) -> dict[str, Change]:
        """Rows of new documents in the tables that depend on them alone."""
        return {"entities": replacing(fresh, "entity_id"), "postings": self._each(fresh, lexical.postings(fresh, _text())), "vectors": self._each(fresh, self.embed(fresh))}

    @staticmethod
    def _each(fresh: DataFrame, rows: DataFrame) -> Change:
        return Change(rows, [fresh.select("entity_id").distinct()])

    def _citations(self, base: Snapshot, fresh: DataFrame, gone: DataFrame) -> dict[str, Change]:
        """What new documents cite, and who cites their titles."""
        from statuta.plans.ingest import cited_titles, citation_needles

        new = fresh.select("entity_id")
        moved = new.union(gone.select("entity_id")).distinct()
        needles = cut(citation_needles(fresh))
        rest = lambda df, key: df.join(moved.withColumnRenamed("entity_id", key), key, "left_anti")
        old_titles = rest(base.table("entities"), "entity_id").select("entity_id", "type", "title")
        new_titles = fresh.select("entity_id", "type", "title")
        old_needles = rest(base.table("needles"), "src").select("src", "needle")
        found = reduce(DataFrame.union, (cited_titles(needles, old_titles.union(new_titles)), cited_titles(old_needles, new_titles))).distinct()
        ends = [moved.withColumnRenamed("entity_id", end) for end in ("src", "dst")]
        return {"needles": Change(needles, ends[:1]), "citations": Change(found, ends)}

    def get(self, ids: DataFrame) -> DataFrame:
        return self.entities().join(ids.select("entity_id").distinct(), "entity_id", "left_semi")

    def neighbours(self, types: tuple[str, ...] = EXPANDED, limit: int | None = None) -> DataFrame:
        return graph.neighbours(self.edges(), self.entities(), types, limit)

    def version_chains(self) -> DataFrame:
        return versions.chains(self.entities(), self.edges())

    def retrieval(self, requests: DataFrame, **options):
        """Hybrid retrieval over the stored tables, all as of one change."""
        from statuta.plans.retrieve import Retrieval

        at = self.store.snapshot().number
        return Retrieval(requests, self.entities(at), self.edges(at), postings=self.postings(at), vectors=self.vectors(at), **options)
