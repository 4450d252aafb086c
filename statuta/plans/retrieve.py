"""Hybrid retrieval for a whole table of requests at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.lineage import cut
from statuta.functions.predicates import ALL, EXPANDED, authority_label, authority_rank, require_departments, type_allowed, valid_at, visible
from statuta.functions.text import DIGIT, SPACE
from statuta.operators import graph, lexical, vectors, versions
from statuta.operators.ranks import Channel
from statuta.operators.titles import article_matches

#: Recall width in top_k, least documents of a type, rank fusion constant, expansion and citation limits.
RECALL_WIDTH, MIN_PER_TYPE, RRF_K, EXPANSION_LIMIT, CITATION_LIMIT = 5, 5, 60, 3, 10
#: First hits of each channel that ``best_ranks`` begins with, and by how much fused scores, of nine digits, may lie beside their bounds.
PROBE, MARGIN = 2048, 2e-9
#: What the channels' hits are there for, by the channels' numbers.
REASONS = ("lexical_match", "vector_match")
ARTICLE = rf"제{SPACE}*({DIGIT}+){SPACE}*조(?:{SPACE}*의{SPACE}*({DIGIT}+))?"


def article_needles(query: Column) -> Column:
    """Distinct article names in the order of a query, written without spaces."""
    hits = F.regexp_extract_all(query, F.lit(ARTICLE), F.lit(0))
    name = lambda h: F.concat(F.lit("제"), F.regexp_extract(h, ARTICLE, 1), F.lit("조"), F.when(F.regexp_extract(h, ARTICLE, 2) != "", F.concat(F.lit("의"), F.regexp_extract(h, ARTICLE, 2))).otherwise(F.lit("")))
    return F.array_distinct(F.transform(hits, name))


def noop_rerank(selected: DataFrame) -> DataFrame:
    """Scores n to 1 in the order of the pool."""
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    at = F.row_number().over(W.partitionBy("query_id").orderBy("pool_rank"))
    return selected.withColumn("rerank_score", (n - at + 1).cast("double"))


def overlap_rerank(requests: DataFrame, entities: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A reranker by the share of a request's words that a document has."""
    from statuta.functions.text import tokens

    def run(selected: DataFrame) -> DataFrame:
        texts = entities.select("entity_id", F.array_distinct(tokens(F.concat_ws("\n", "title", "body"))).alias("words"))
        asked = requests.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("terms"))
        both = selected.join(asked, "query_id").join(texts, "entity_id")
        return both.withColumn("rerank_score", F.round(F.size(F.array_intersect("terms", "words")) / F.greatest(F.size("terms"), F.lit(1)), 6)).drop("terms", "words")

    return run


@dataclass
class Retrieval:
    """One run over requests (query_id, query, dept, as_of, top_k, source_types); every step is a DataFrame.

    A request without a department raises an error when the result is read. An embedder takes the place of hashed
    vectors on both sides; given ``vectors`` must then be its own. The index tables (version map,
    postings, hashed vectors) may be given, as a stored snapshot has them, or are derived from the entities.
    ``hits`` (the columns of ``channel_hits``) stand for the search of both channels.
    Steps that later ones use more than once (hits, cited, base) are written to the shared folder once.
    """

    requests: DataFrame
    entities: DataFrame
    edges: DataFrame
    version_map: DataFrame | None = None
    postings: DataFrame | None = None
    vectors: DataFrame | None = None
    rerank: Callable[[DataFrame], DataFrame] = noop_rerank
    embedder: vectors.Embedder | None = None
    unlimited: bool = False
    hits: DataFrame | None = None

    def __post_init__(self) -> None:
        self.requests = require_departments(self.requests)
        self.version_map = versions.chains(self.entities, self.edges) if self.version_map is None else self.version_map

    @cached_property
    def facts(self) -> DataFrame:
        return self.entities.select("entity_id", "type", "allowed_depts", "effective_date", "superseded_date")

    def _resolved(self, hits: DataFrame) -> DataFrame:
        """Hits with as_of, dept and source_types to visible versions of allowed types."""
        found = versions.resolve(hits, self.entities, self.version_map)
        facts = self.facts.select(F.col("entity_id").alias("resolved_id"), "type", "allowed_depts")
        return found.join(facts, "resolved_id").where(visible(F.col("allowed_depts"), F.col("dept")) & type_allowed(F.col("source_types"), F.col("type")))

    @cached_property
    def cited(self) -> DataFrame:
        """(query_id, entity_id, score, reason, phase, seq): documents whose title has an article that a query names."""
        needles = self.requests.select("query_id", "dept", "as_of", "source_types", F.posexplode(article_needles(F.col("query"))).alias("needle_no", "needle"))
        hits = article_matches(needles, self.entities).drop("type", "title")
        hits = cut(hits.withColumn("n", F.row_number().over(W.partitionBy("query_id", "needle_no").orderBy("entity_id"))).where(F.col("n") <= CITATION_LIMIT))
        first = self._resolved(hits).groupBy("query_id", "resolved_id").agg(F.min(F.struct("needle_no", "n")).alias("first"))
        seq = F.row_number().over(W.partitionBy("query_id").orderBy("first", "resolved_id"))
        return cut(first.select("query_id", F.col("resolved_id").alias("entity_id"), F.lit(1.0).alias("score"), F.lit("citation_match").alias("reason"), F.lit(0).alias("phase"), seq.alias("seq")))

    @cached_property
    def recall_width(self) -> Column | None:
        return None if self.unlimited else F.col("top_k") * RECALL_WIDTH

    @cached_property
    def lexical_hits(self) -> DataFrame:
        if self.postings is not None:
            return lexical.bm25(self.requests, self.postings, self.recall_width)
        text = F.concat_ws("\n", "title", "body")
        if self.recall_width is not None:
            return lexical.TextSearch(self.requests, self.entities, text, self.recall_width).hits
        return lexical.bm25(self.requests, lexical.postings(self.entities, text), None, lexical.length_stats(self.entities, text))

    @cached_property
    def query_vectors(self) -> DataFrame:
        return vectors.hash_vectors(self.requests, F.col("query"), "query_id") if self.embedder is None else self.embedder.query_vectors(self.requests)

    @cached_property
    def document_vectors(self) -> DataFrame:
        if self.vectors is not None:
            return self.vectors
        if self.embedder is not None:
            return self.embedder.document_vectors(self.entities, None, *vectors.FACTS)
        return vectors.hash_vectors(self.entities, F.concat_ws("\n", "title", "body"), "entity_id", *vectors.FACTS)

    @cached_property
    def dimensions(self) -> int:
        return vectors.DIMENSIONS if self.embedder is None else self.embedder.dimensions

    @cached_property
    def vector_hits(self) -> DataFrame:
        return vectors.search(self.requests, self.query_vectors, self.entities, self.document_vectors, self.recall_width, dimensions=self.dimensions)

    @cached_property
    def channel_hits(self) -> DataFrame:
        """(query_id, entity_id, rank, channel, reason): the hits of both channels."""
        if self.hits is not None:
            return self.hits
        channel = lambda hits, k: hits.select("query_id", "entity_id", "rank", F.lit(k).alias("channel"), F.lit(REASONS[k]).alias("reason"))
        return cut(channel(self.lexical_hits, 0).union(channel(self.vector_hits, 1)))

    @cached_property
    def pool(self) -> DataFrame:
        """(query_id, entity_id, type, fused, reason, pool_rank): both channels fused by rank, without the cited ones."""
        return self._fused(self.channel_hits)

    def _fresh(self, hits: DataFrame) -> DataFrame:
        """Hits to visible versions that are not cited."""
        hits = hits.join(self.requests.select("query_id", "dept", "as_of", "source_types"), "query_id")
        return self._resolved(hits).join(self.cited.select("query_id", F.col("entity_id").alias("resolved_id")), ["query_id", "resolved_id"], "left_anti")

    def _fused(self, hits: DataFrame) -> DataFrame:
        fused = self._fresh(hits).groupBy("query_id", "resolved_id", "type").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("fused"), F.min(F.struct("channel", "rank", "reason")).alias("first"))
        order = W.partitionBy("query_id").orderBy(F.desc("fused"), "first.channel", "first.rank", "resolved_id")
        return fused.select("query_id", F.col("resolved_id").alias("entity_id"), "type", "fused", F.col("first.reason").alias("reason"), F.row_number().over(order).alias("pool_rank"))

    @cached_property
    def channels(self) -> list[Channel]:
        """The searches of both channels without a width, in the order of their numbers."""
        by_text = lexical.TextSearch(self.requests, self.entities, F.concat_ws("\n", "title", "body"), None).channel
        return [by_text, vectors.channel(self.requests, self.query_vectors, self.entities, self.document_vectors, dimensions=self.dimensions)]

    def _leading(self, probe: int, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Hits (query_id, entity_id, rank, channel, reason) down to a depth of ``probe`` at least, and (query_id, channel, spare).

        ``spare`` is the most that one further hit of that channel adds to a fused score; where all hits are there it has no row.
        """
        width = F.greatest(F.lit(probe), F.col("top_k") * RECALL_WIDTH)
        each = [c.leading(wanted.select("query_id").join(self.requests.select("query_id", "top_k"), "query_id"), width) for c in self.channels]
        hits = [h.select("query_id", "entity_id", "rank", F.lit(k).alias("channel"), F.lit(reason).alias("reason")) for k, ((h, _), reason) in enumerate(zip(each, REASONS))]
        spare = [d.where("depth < total").select("query_id", F.lit(k).alias("channel"), (1.0 / (RRF_K + F.col("depth") + 1)).alias("spare")) for k, (_, d) in enumerate(each)]
        return reduce(DataFrame.union, hits), reduce(DataFrame.union, spare)

    @cached_property
    def first_hits(self) -> tuple[DataFrame, DataFrame]:
        return self._leading(PROBE, self.requests)

    def limited(self) -> Retrieval:
        """The run with a recall width, out of the first hits of this one, which has none."""
        width = self.requests.select("query_id", (F.col("top_k") * RECALL_WIDTH).alias("width"))
        return replace(self, unlimited=False, hits=cut(lexical.within(self.first_hits[0].join(width, "query_id"))))

    def best_ranks(self, kind: str, probe: int = PROBE) -> DataFrame:
        """(query_id, true_rank): the best place in the pool of a document of a type, exactly, without writing most hits.

        Of each channel the first ``probe`` hits are known. The others of a version chain are as many as its members
        at most, all of later ranks, so each chain has a least and a most fused score. Chains whose most lies below the
        best least of one of the type are behind it; the later hits of the rest are looked up and their ranks counted, which
        gives these chains' places in the whole pool. Requests for which chains without a first hit may reach that
        score, or without a chain of the type, go on with sixteen times as many hits, until these are all there are.
        """
        found, spare = self.first_hits if probe == PROBE else self._leading(probe, self.requests)
        wanted, done = cut(self.requests.select("query_id")), []
        while True:
            ranks, left = self._settled(kind, wanted, found, spare)
            done.append(ranks)
            wanted = cut(left.join(self._may_find(kind), "query_id", "left_semi"))
            if wanted.isEmpty():
                return reduce(DataFrame.union, done)
            probe *= 16
            found, spare = self._leading(probe, wanted)

    def _settled(self, kind: str, wanted: DataFrame, found: DataFrame, spare: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Places of those requests for which the hits found are enough, and (query_id) of the others; see ``best_ranks``."""
        of = lambda k: F.coalesce(F.max(F.when(F.col("channel") == k, F.col("spare"))), F.lit(0.0)).alias(f"spare{k}")
        spares = wanted.join(spare, "query_id", "left").groupBy("query_id").agg(of(0), of(1))
        sizes = cut(self.version_map.groupBy("chain_id").agg(F.count(F.lit(1)).alias("members")))
        number = lambda k: F.count(F.when(F.col("channel") == k, 1)).alias(f"n{k}")
        each = self._fresh(found).groupBy("query_id", "resolved_id", "type").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("low"), number(0), number(1))
        each = each.join(self.version_map.withColumnRenamed("entity_id", "resolved_id"), "resolved_id").join(sizes, "chain_id").join(spares, "query_id")
        chains = cut(each.select("query_id", "chain_id", "type", "low", sum((F.col(f"spare{k}") * (F.col("members") - F.col(f"n{k}")) for k in (0, 1)), F.col("low")).alias("high")))
        least = chains.where(F.col("type") == kind).groupBy("query_id").agg(F.max("low").alias("least"))
        others = (F.col("spare0") + F.col("spare1")) * F.col("members")
        state = spares.join(least, "query_id", "left").join(F.broadcast(sizes.agg(F.max("members").alias("members"))))  # one row
        state = cut(state.select("query_id", "least", F.coalesce((others == 0) | (F.col("least") > others + MARGIN), F.lit(False)).alias("sure")))
        near = chains.join(state.where("sure"), "query_id").where(F.col("high") >= F.col("least") - MARGIN)
        members = cut(near.select("query_id", "chain_id").join(self.version_map, "chain_id").select("query_id", "entity_id"))
        hits = [found.join(members, ["query_id", "entity_id"], "left_semi")]
        for k, (channel, reason) in enumerate(zip(self.channels, REASONS)):
            own = lambda df: df.where(F.col("channel") == k)
            later = members.join(own(spare), "query_id", "left_semi").join(own(found), ["query_id", "entity_id"], "left_anti")
            hits.append(channel.ranks(cut(later)).select("query_id", "entity_id", "rank", F.lit(k).alias("channel"), F.lit(reason).alias("reason")))
        ranks = self._fused(reduce(DataFrame.union, hits)).where(F.col("type") == kind).groupBy("query_id").agg(F.min("pool_rank").alias("true_rank"))
        return cut(ranks), state.where("not sure").select("query_id")

    def _may_find(self, kind: str) -> DataFrame:
        """(query_id): requests that may see a document of a type, of which one has begun by their date."""
        start = F.coalesce("effective_date", F.lit(versions.OLDEST).cast("date"))
        begun = self.facts.where(F.col("type") == kind).select(start.alias("start"), F.explode("allowed_depts").alias("dept")).groupBy("dept").agg(F.min("start").alias("start"))
        asked = self.requests.where(type_allowed(F.col("source_types"), F.lit(kind))).select("query_id", "as_of", F.explode(F.array_distinct(F.array("dept", F.lit(ALL)))).alias("dept"))
        return asked.join(begun, "dept").where("start <= as_of").select("query_id").distinct()

    @cached_property
    def selected(self) -> DataFrame:
        """The best top_k of the pool and the first MIN_PER_TYPE of each type, unless one type alone was asked for."""
        placed = self.pool.withColumn("type_rank", F.row_number().over(W.partitionBy("query_id", "type").orderBy("pool_rank")))
        asked = placed.join(self.requests.select("query_id", "top_k", "source_types"), "query_id")
        many = F.col("source_types").isNull() | (F.size("source_types") != 1)
        return asked.where((F.col("pool_rank") <= F.col("top_k")) | (many & (F.col("type_rank") <= MIN_PER_TYPE))).drop("top_k", "source_types")

    @cached_property
    def base(self) -> DataFrame:
        ranked = self.rerank(self.selected)
        seq = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "pool_rank"))
        return cut(self.cited.union(ranked.select("query_id", "entity_id", F.col("rerank_score").alias("score"), "reason", F.lit(1).alias("phase"), seq.alias("seq"))))

    @cached_property
    def expanded(self) -> DataFrame:
        """Documents one edge away from those found, at most EXPANSION_LIMIT each before any filter."""
        near = graph.neighbours(self.edges, self.entities, EXPANDED, EXPANSION_LIMIT)
        found = self.base.join(near, "entity_id").groupBy("query_id", "neighbour").agg(F.min(F.struct("phase", "seq", "position")).alias("first"))
        fresh = found.join(self.base.select("query_id", F.col("entity_id").alias("neighbour")), ["query_id", "neighbour"], "left_anti")
        facts = self.facts.select(F.col("entity_id").alias("neighbour"), "type", "allowed_depts", "effective_date", "superseded_date")
        asked = fresh.join(facts, "neighbour").join(self.requests.select("query_id", "dept", "as_of", "source_types"), "query_id")
        kept = asked.where(visible(F.col("allowed_depts"), F.col("dept")) & valid_at(F.col("effective_date"), F.col("superseded_date"), F.col("as_of")) & type_allowed(F.col("source_types"), F.col("type")))
        seq = F.row_number().over(W.partitionBy("query_id").orderBy("first", "neighbour"))
        return kept.select("query_id", F.col("neighbour").alias("entity_id"), F.lit(0.0).alias("score"), F.lit("1hop_expansion").alias("reason"), F.lit(2).alias("phase"), seq.alias("seq"))

    @cached_property
    def result(self) -> DataFrame:
        """(query_id, position, entity_id, type, score, reason) in the order of authority, then score, then arrival."""
        every = self.base.union(self.expanded).join(self.facts.select("entity_id", "type"), "entity_id")
        order = W.partitionBy("query_id").orderBy(authority_rank(F.col("type")), F.desc("score"), "phase", "seq")
        return every.select("query_id", F.row_number().over(order).alias("position"), "entity_id", "type", "score", "reason")


def evidence_blocks(requests: DataFrame, result: DataFrame, entities: DataFrame, head: str | None = None, nothing: str | None = None) -> DataFrame:
    """(query_id, evidence): one text a request, its documents in order after a head; another text where there are none."""
    facts = entities.select("entity_id", "title", "body", "effective_date")
    block = F.format_string('<document id="%s" type="%s" authority="%s" title="%s" effective_date="%s">\n%s\n</document>', "entity_id", "type", authority_label(F.col("type")), "title", F.coalesce(F.col("effective_date").cast("string"), F.lit("")), "body")
    texts = result.join(facts, "entity_id").select("query_id", F.struct("position", block.alias("block")).alias("b"))
    joined = texts.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("blocks"))
    return requests.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce(F.concat(F.lit(EVIDENCE_HEAD if head is None else head), "blocks"), F.lit(NO_EVIDENCE if nothing is None else nothing)).alias("evidence"))


#: What stands before the evidence, and instead of it, unless the caller gives other words.
EVIDENCE_HEAD = "찾은 문서 (권위 높은 순). 인용 형식: [[CITE:문서 id]]\n\n"
NO_EVIDENCE = "찾은 문서 없음."


def diagnose(narrow: Retrieval, wide: Retrieval, kind: str = "law") -> DataFrame:
    """(query_id, found, true_rank, needed_width): whether the real run has a document of a type, and its best rank without width limit."""
    real = narrow.result.where(F.col("type") == kind).groupBy("query_id").agg(F.lit(True).alias("found"))
    best = wide.best_ranks(kind)
    joined = narrow.requests.select("query_id", "top_k").join(real, "query_id", "left").join(best, "query_id", "left")
    return joined.select("query_id", F.coalesce("found", F.lit(False)).alias("found"), F.col("true_rank").cast("bigint"), F.ceil(F.col("true_rank") / F.col("top_k")).cast("bigint").alias("needed_width"))
