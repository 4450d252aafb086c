"""Hashed n-gram embeddings in sparse form, and cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions.lineage import cut
from statuta.functions.predicates import ALL, type_from_id
from statuta.functions.text import content_hash
from statuta.operators.balls import Balls
from statuta.operators.lexical import ranked, width_or_null, within
from statuta.operators.ranks import Channel

#: Dimensions and least score of a hit.
DIMENSIONS, MIN_SCORE = 256, 0.05
#: Columns that decide whether a request may see a document.
FACTS = ("allowed_depts", "effective_date", "superseded_date")
#: Characters of text whose grams are counted together.
SLICE_CHARS = 1 << 18
#: Possible grams up to which they are found in a table of all, and not by sorting.
GRAM_CELLS = 1 << 22
#: Queries and rows that meet in one block of the dense search.
QUERY_BLOCK, ROW_BLOCK = 1024, 4096


@lru_cache(1 << 16)
def _gram_place(gram: str) -> int:
    """Place of a gram's count, or that less DIMENSIONS where the count is taken off."""
    sign, place = sha256(gram.encode()).digest()[-2:]
    return place if sign % 2 == 0 else place - DIMENSIONS


def _gram_sums(texts: list[str]) -> np.ndarray:
    """(texts, DIMENSIONS): signed counts of the character 2- and 3-grams; a shorter text is its own gram.

    Grams of all texts are numbers over the characters that occur, and each distinct one is hashed once.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    there = np.zeros(int(codes.max(initial=0)) + 1, dtype=bool)
    there[codes] = True
    letters = [chr(c) for c in np.flatnonzero(there).tolist()]
    n = len(letters)
    few = n**3 + n * n <= GRAM_CELLS
    own = (np.cumsum(there) - 1).astype(np.int32 if few else np.int64)[codes]
    pairs, triples = row[1:] == row[:-1], row[2:] == row[:-2]
    two = own[:-1] * n + own[1:]
    keys = np.concatenate([two[pairs], (n * n + two[:-1] * n + own[2:])[triples]])
    if few:
        seen = np.zeros(n**3 + n * n, dtype=bool)
        seen[keys] = True
        grams, at = np.flatnonzero(seen), keys
    else:
        grams, at = np.unique(keys, return_inverse=True)
    spelled = lambda g: letters[g // n] + letters[g % n] if g < n * n else letters[(g := g - n * n) // (n * n)] + letters[g // n % n] + letters[g % n]
    signed = np.array([_gram_place(spelled(g)) for g in grams.tolist()], dtype=np.int16)
    if few:
        table = np.zeros(n**3 + n * n, dtype=np.int16)
        table[grams] = signed
        signed = table
    short = np.flatnonzero(lengths < 2).astype(np.int32)
    place = np.concatenate([signed[at], np.array([_gram_place(texts[k]) for k in short], dtype=np.int16)])
    owner = np.concatenate([row[:-1][pairs], row[:-2][triples], short])
    held = np.bincount(owner.astype(np.int64) * (2 * DIMENSIONS) + (place + DIMENSIONS), minlength=len(texts) * 2 * DIMENSIONS).reshape(-1, 2, DIMENSIONS)
    return (held[:, 1] - held[:, 0]).astype(np.float64)


def hash_vectors(docs: DataFrame, text: Column, id_col: str, *more: str) -> DataFrame:
    """(id, more columns, places array<int>, weights array<double>): the unit vector of signed n-gram counts of every row, without its zeros.

    Texts go through the tasks in slices of about SLICE_CHARS characters, and nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), *more, F.lower(F.coalesce(text, F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            total, first = 0, 0
            for k in range(1, len(texts) + 1):
                total += len(texts[k - 1])
                if k == len(texts) or total >= SLICE_CHARS:
                    sums = _gram_sums(texts[first:k])
                    r, place = np.nonzero(sums)
                    weight = sums[r, place] / np.sqrt((sums * sums).sum(axis=1))[r]
                    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(r, minlength=k - first))].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (place.astype(np.int32), weight)]
                    own = [batch.column(c).slice(first, k - first) for c in ("id", *more)]
                    yield pa.RecordBatch.from_arrays([*own, *lists], ["id", *more, "places", "weights"])
                    total, first = 0, k

    kinds = T.StructType([*(rows.schema[c] for c in ("id", *more)), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, kinds).withColumnRenamed("id", id_col)


def hash_embed(docs: DataFrame, text: Column, id_col: str) -> DataFrame:
    """(id, idx, w): the same vectors, a row for each place."""
    held = hash_vectors(docs, text, id_col)
    return held.select(id_col, F.explode(F.arrays_zip("places", "weights")).alias("x")).select(id_col, F.col("x.places").alias("idx"), F.col("x.weights").alias("w"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense arrays; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def _unit(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    size = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return flat / np.where(size > 0, size, 1) if len(flat) else flat


def nearest(asked: DataFrame, rows: DataFrame, k: int, min_score: float = MIN_SCORE) -> DataFrame:
    """(query_id, vec_id, score, rank): the best k of all rows (vec_id, embedding) for each of asked (query_id, embedding).

    Both sides are dealt into blocks; each pair of blocks meets once and keeps its best k a query, which a
    second ranking merges; the block numbers of both sides are of one type, so that equal ones hash alike. A
    row is not its own hit; vectors compare with those of their own length, and ones with a null element with
    none. Scores are rounded to six digits before ranking, ties go by id.
    """
    sound = lambda df, key: df.where(F.col(key).isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull()) & (F.size("embedding") > 0))
    asked, rows = sound(asked, "query_id"), sound(rows, "vec_id")
    query_blocks, row_blocks = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (rows, ROW_BLOCK)))
    dealt = lambda df, own, n, other, m: df.withColumn("length", F.size("embedding")).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = dealt(asked, "query_block", query_blocks, "row_block", row_blocks)
    right = dealt(rows, "row_block", row_blocks, "query_block", query_blocks)
    by = ["length", "query_block", "row_block"]

    def best(queries: pa.Table, others: pa.Table) -> pa.Table:
        names, ids = (t.column(c).to_numpy() for t, c in ((queries, "query_id"), (others, "vec_id")))
        if not len(names) or not len(ids):
            return pa.table({"query_id": names[:0], "vec_id": ids[:0], "score": np.zeros(0)})
        length = queries.column("length")[0].as_py()
        score = np.round(_unit(queries.column("embedding"), length) @ _unit(others.column("embedding"), length).T, 6)
        score[np.isnan(score)] = np.inf
        score[names[:, None] == ids[None, :]] = -np.inf
        least = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(names), -np.inf)
        q, r = np.nonzero(score >= np.maximum(least, min_score)[:, None])
        order = np.lexsort((ids[r], -score[q, r], q))
        q, r = q[order], r[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, r = q[first], r[first]
        found = score[q, r]
        return pa.table({"query_id": names[q], "vec_id": ids[r], "score": np.where(np.isinf(found), np.nan, found)})

    kinds = asked.schema["query_id"].dataType.simpleString(), rows.schema["vec_id"].dataType.simpleString()
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    return ranked(found, "vec_id").where(F.col("rank") <= k)


def _matrix(table: pa.Table, dimensions: int) -> np.ndarray:
    out = np.zeros((table.num_rows, dimensions))
    places, weights = (table.column(c).combine_chunks() for c in ("places", "weights"))
    row = np.repeat(np.arange(table.num_rows), np.asarray(pc.list_value_length(places), dtype=np.int64))
    out[row, np.asarray(places.flatten())] = np.asarray(weights.flatten())
    return out


def _may_see(queries: pa.Table, others: pa.Table) -> np.ndarray:
    """(queries, documents): visible in the department, valid on the date, of an allowed type."""
    day = lambda t, c, default: np.asarray(pc.fill_null(t.column(c).combine_chunks().cast(pa.int32()).cast(pa.int64()), default))
    begin, end, at = day(others, "effective_date", -(1 << 40)), day(others, "superseded_date", 1 << 40), day(queries, "as_of", 0)
    seen = (begin <= at[:, None]) & (at[:, None] < end) & np.asarray(pc.is_valid(queries.column("as_of")))[:, None]
    depts = others.column("allowed_depts").combine_chunks()
    row = np.repeat(np.arange(others.num_rows), np.asarray(pc.fill_null(pc.list_value_length(depts), 0), dtype=np.int64))
    names, kinds = depts.flatten(), others.column("type").combine_chunks()
    holds = lambda name: np.bincount(row[np.asarray(pc.fill_null(pc.equal(names, name), False), dtype=bool)], minlength=others.num_rows) > 0
    public, asked, types = holds(ALL), queries.column("dept").to_pylist(), queries.column("source_types").to_pylist()
    own = {d: public | holds(d) for d in set(asked)}
    allowed = {t: np.asarray(pc.fill_null(pc.is_in(kinds, pa.array(t, pa.string())), False), dtype=bool) for t in {tuple(t) for t in types if t is not None}}
    for k, (d, t) in enumerate(zip(asked, types)):
        seen[k] &= own[d] if t is None else own[d] & allowed[tuple(t)]
    return seen


def _cosines(queries: pa.Table, own: np.ndarray, others: pa.Table, matrix: np.ndarray) -> np.ndarray:
    """(queries, documents): rounded cosines, -inf where a query may not see the document."""
    score = np.round(own @ matrix.T, 6)
    score[~_may_see(queries, others)] = -np.inf
    return score


def _sides(requests: DataFrame, query_vectors: DataFrame, entities: DataFrame, vectors: DataFrame, width: Column | None) -> tuple[DataFrame, DataFrame]:
    """Requests and documents with their vectors and what decides whether one may see the other."""
    asked = requests.select("query_id", "dept", "as_of", "source_types", width_or_null(width)).join(query_vectors, "query_id")
    known = vectors if set(FACTS) <= set(vectors.columns) else entities.select("entity_id", *FACTS).join(vectors, "entity_id")
    return asked, known.select("entity_id", type_from_id(F.col("entity_id")).alias("type"), *FACTS, "places", "weights")


def channel(requests: DataFrame, query_vectors: DataFrame, entities: DataFrame, vectors: DataFrame, min_score: float = MIN_SCORE, dimensions: int = DIMENSIONS) -> Channel:
    """The hits of ``search`` without a width, for their ranks."""
    asked, rows = _sides(requests, query_vectors, entities, vectors, None)

    def scores(queries: pa.Table) -> Callable[[pa.Table], np.ndarray]:
        own = _matrix(queries, dimensions)

        def run(others: pa.Table) -> np.ndarray:
            score = _cosines(queries, own, others, _matrix(others, dimensions))
            return np.where(score >= min_score, score, -np.inf)

        return run

    return Channel(cut(asked), cut(rows), scores)


def search(requests: DataFrame, query_vectors: DataFrame, entities: DataFrame, vectors: DataFrame, width: Column | None, min_score: float = MIN_SCORE, dimensions: int = DIMENSIONS) -> DataFrame:
    """(query_id, entity_id, score, rank): visible, valid documents of allowed types by cosine, all of them without a width.

    Vectors are those of ``hash_vectors`` or of an ``Embedder``; where they have FACTS beside them, documents are not
    joined with them. Scores are rounded to six digits before ranking,
    ties go by id.
    """
    return within(ranked(balls(requests, query_vectors, entities, vectors, width, min_score, dimensions).hits))


def balls(requests: DataFrame, query_vectors: DataFrame, entities: DataFrame, vectors: DataFrame, width: Column | None, min_score: float = MIN_SCORE, dimensions: int = DIMENSIONS, **sizes: int) -> Balls:
    """The search behind ``search``. In a block the request's predicates come first, then the best of what is left."""
    asked, rows = _sides(requests, query_vectors, entities, vectors, width)

    def best(queries: pa.Table, others: pa.Table, matrix: np.ndarray) -> pa.Table:
        score = _cosines(queries, _matrix(queries, dimensions), others, matrix)
        q, r, found = [], [], []
        for k, most in enumerate(queries.column("width").to_pylist()):
            own = np.flatnonzero(score[k] >= min_score)
            if most is not None and len(own) > most:  # all that tie with the last one stay for the second ranking
                own = own[score[k, own] >= np.partition(score[k, own], -most)[-most]]
            q.append(np.full(len(own), k))
            r.append(own)
            found.append(score[k, own])
        q, r, found = (np.concatenate(x) if x else np.zeros(0) for x in (q, r, found))
        take = lambda t, c, at: t.column(c).combine_chunks().take(pa.array(at.astype(np.int64)))
        return pa.table({"query_id": take(queries, "query_id", q), "entity_id": take(others, "entity_id", r), "score": pa.array(found.astype(float)), "width": take(queries, "width", q)})

    return Balls(asked, rows, best, lambda table: _matrix(table, dimensions), min_score, **sizes)


def embed_plan(docs: DataFrame, cache: DataFrame, identity: str) -> DataFrame:
    """(entity_id, content_hash, action): reuse what the cache has with the same hash, embed the rest."""
    now = docs.select("entity_id", content_hash(F.lit(identity), F.concat_ws("\n", "title", "body")).alias("content_hash"))
    known = cache.select(F.col("entity_id"), F.col("content_hash"), F.lit(True).alias("known"))
    return now.join(known, ["entity_id", "content_hash"], "left").select("entity_id", "content_hash", F.when(F.col("known"), "reuse").otherwise("embed").alias("action"))


def embed_with(docs: DataFrame, model: Callable[[list[str]], list[list[float]]], text_col: str = "text", id_col: str = "entity_id", batch: int = 10) -> DataFrame:
    """Vectors of a user's model, called with ``batch`` texts at a time inside the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in _modelled(batches, model, batch):
            yield pa.RecordBatch.from_arrays([ids, pa.array([[float(x) for x in v] for v in found], pa.list_(pa.float64()))], [id_col, "embedding"])

    return docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, f"{id_col} string, embedding array<double>")


#: Rows of a user's model that are handed on together.
MODEL_ROWS = 1000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, MODEL_ROWS):
            yield batch.slice(first, MODEL_ROWS)


def _found(texts: pa.Array, model: Callable, size: int) -> list:
    """What a model gives for texts, called with ``size`` of them at a time."""
    found = []
    for a in range(0, len(texts), size):
        found.extend(model(texts.slice(a, size).to_pylist()))
    return found


def _modelled(batches: Iterator[pa.RecordBatch], model: Callable, size: int) -> Iterator[tuple[pa.Array, list]]:
    """Ids (first column) and what a model gives for their texts (second column)."""
    for part in _parts(batches):
        yield part.column(0), _found(part.column(1), model, size)


@dataclass(frozen=True)
class Embedder:
    """A user's model: one function for documents and one for queries (by default the same), called with ``batch`` texts.

    ``identity`` names both models and their settings; a change of it makes all cached vectors stale. The functions
    run inside the tasks, give a list of ``dimensions`` numbers for each text, and must give the same ones again.
    """

    identity: str
    dimensions: int
    documents: Callable[[list[str]], list[list[float]]]
    queries: Callable[[list[str]], list[list[float]]] | None = None
    batch: int = 10

    def _vectors(self, rows: DataFrame, id_col: str, model: Callable, *more: str) -> DataFrame:
        """(id, more columns, places, weights) of rows (id, more columns, text); a row without a text has its vector beside it."""
        dimensions, batch = self.dimensions, self.batch
        own, known = (id_col, *more), "places" in rows.columns
        names, lists = [*own, "places", "weights"], (pa.list_(pa.int32()), pa.list_(pa.float64()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                if known:
                    asked = pc.is_valid(part.column("text"))
                    held, part = part.filter(pc.invert(asked)), part.filter(asked)
                    if held.num_rows:
                        yield pa.RecordBatch.from_arrays([*(held.column(c) for c in own), *(held.column(c).cast(k) for c, k in zip(("places", "weights"), lists))], names)
                found = np.asarray(_found(part.column("text"), model, batch), dtype=np.float64).reshape(part.num_rows, dimensions)
                size = np.sqrt((found * found).sum(axis=1, keepdims=True))
                offsets = pa.array(np.arange(0, found.size + 1, dimensions, dtype=np.int32))
                values = (np.tile(np.arange(dimensions, dtype=np.int32), len(found)), (found / np.where(size > 0, size, 1)).ravel())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *(pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values)], names)

        kinds = T.StructType([*(rows.schema[c] for c in own), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
        return rows.select(*own, "text", *(("places", "weights") if known else ())).mapInArrow(run, kinds)

    def query_vectors(self, requests: DataFrame) -> DataFrame:
        """(query_id, places, weights) of unit length; a vector of zeros stays one."""
        return self._vectors(requests.select("query_id", F.coalesce("query", F.lit("")).alias("text")), "query_id", self.queries or self.documents)

    def document_vectors(self, docs: DataFrame, cache: DataFrame | None = None, *more: str) -> DataFrame:
        """(entity_id, places, weights, content_hash, more columns) of documents (entity_id, title, body, more columns).

        Rows of ``cache`` (the first four columns) stand for documents whose text and model have not changed; only the
        others are given to the model. Both sides are read once and meet in one join.
        """
        text = F.concat_ws("\n", "title", "body")
        own = ("content_hash", *more)
        rows = docs.where("entity_id is not null").select("entity_id", *more, text.alias("text"), content_hash(F.lit(self.identity), text).alias("content_hash"))
        if cache is not None:
            held = cache.select("entity_id", "content_hash", "places", "weights")
            rows = rows.join(held, ["entity_id", "content_hash"], "left").withColumn("text", F.when(F.col("places").isNull(), F.col("text")))
        return self._vectors(rows, "entity_id", self.documents, *own).select("entity_id", "places", "weights", *own)
