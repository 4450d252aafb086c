"""Title search by any text, versions in force over long chains, and a user's model for both sides."""

import datetime as dt
import random

import numpy as np

from statuta.operators import vectors, versions
from statuta.operators.titles import title_matches
from statuta.plans.retrieve import Retrieval

DAY = dt.date(2020, 1, 1)


def test_any_needle(spark):
    rng = random.Random(2)
    titles = ["".join(rng.choice("가나법 제1조ab😀%_\\") for _ in range(rng.randrange(0, 30))) for _ in range(120)] + [None, "", "a", "ab"]
    needles = [t[a : a + n] for t in titles if t for a, n in ((rng.randrange(len(t)), rng.randrange(1, 41)),)] + ["", None, "없는말", "zz", "q"]
    entities = spark.createDataFrame([(f"law:{k}", "law", t) for k, t in enumerate(titles)], "entity_id string, type string, title string")
    asked = spark.createDataFrame(list(enumerate(needles)) + [(999, "a")], "query_id int, needle string")
    found = sorted((r["query_id"], r["entity_id"]) for r in title_matches(asked, entities).collect())
    want = sorted((k, f"law:{i}") for k, n in [*enumerate(needles), (999, "a")] if n for i, t in enumerate(titles) if t and n in t)
    assert found == want and len(found) > 200
    plan = title_matches(asked, entities)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def brute(members, at):
    valid = [m for m in members if (m[1] is None or m[1] <= at) and (m[2] is None or at < m[2])]
    begun = [m for m in members if m[1] is None or m[1] <= at]
    key = lambda m: m[1] or dt.date(1, 1, 1)
    if valid:
        return min(valid, key=lambda m: (key(m), m[0]))[0]
    return min(begun, key=lambda m: (-key(m).toordinal(), m[0]))[0] if begun else None


def test_sweep_against_brute_force(spark):
    rng = random.Random(5)
    day = lambda: DAY + dt.timedelta(rng.randrange(40))
    members = [(f"law:{k:03d}", rng.choice([None, day(), day(), day()]), rng.choice([None, day(), day()])) for k in range(160)]
    chains = {m[0]: f"c{rng.randrange(25)}" for m in members}
    hits = [(q, rng.choice(members)[0], rng.choice([None, day(), DAY - dt.timedelta(1)])) for q in range(400)] + [(999, "law:none", DAY)]
    entities = spark.createDataFrame(members, "entity_id string, effective_date date, superseded_date date")
    found = versions.resolve(spark.createDataFrame(hits, "query_id int, entity_id string, as_of date"), entities, spark.createDataFrame(list(chains.items()), "entity_id string, chain_id string"))
    want = {}
    for q, entity, at in hits:
        if at and entity in chains and (r := brute([m for m in members if chains[m[0]] == chains[entity]], at)):
            want[q] = r
    assert {r["query_id"]: r["resolved_id"] for r in found.collect()} == want


def test_one_chain_of_many_versions(spark):
    n = 100_000
    entities = spark.range(n).selectExpr("concat('law:', lpad(id, 6, '0')) entity_id", "date_add(date'1800-01-01', cast(id div 2 as int)) effective_date", "case when id % 3 <> 0 then date_add(date'1800-01-01', cast(id div 2 + 3 as int)) end superseded_date")
    whole = entities.selectExpr("entity_id", "'c' chain_id")
    hits = spark.range(40_000).selectExpr("id query_id", "'law:000000' entity_id", "date_add(date'1800-01-01', cast(id as int)) as_of")
    found = versions.resolve(hits, entities, whole)
    assert found.count() == 40_000 and {r[0] for r in found.select("resolved_id").distinct().collect()} == {"law:000000"}  # it never ends


def test_a_users_model_on_both_sides(spark):
    calls = spark.sparkContext.accumulator(0)

    def documents(texts):
        calls.add(len(texts))
        return [[float("x" in t), float("y" in t)] for t in texts]

    model = vectors.Embedder("m1", 2, documents, lambda texts: [[float("y" in t), float("x" in t)] for t in texts], batch=2)
    kind = "entity_id string, type string, title string, body string, effective_date date, superseded_date date, allowed_depts array<string>, source string"
    entities = spark.createDataFrame([(f"faq:{k}", "faq", t, "", None, None, ["ALL"], "") for k, t in enumerate(["x", "y", "none"])], kind)
    held = model.document_vectors(entities).cache()
    assert held.count() == 3 and calls.value == 3
    changed = entities.selectExpr("entity_id", "case when entity_id = 'faq:2' then 'x y' else title end title", "body")
    again = model.document_vectors(changed, held)
    assert {r["entity_id"]: [round(w, 3) for w in r["weights"]] for r in again.collect()} == {"faq:0": [1, 0], "faq:1": [0, 1], "faq:2": [0.707, 0.707]}
    assert calls.value == 4
    other = vectors.Embedder("m2", 2, documents)
    assert other.document_vectors(changed, held).count() == 3 and calls.value >= 7
    request = spark.createDataFrame([(1, "x", "IB", DAY, 3, None)], "query_id int, query string, dept string, as_of date, top_k int, source_types array<string>")
    found = Retrieval(request, entities, spark.createDataFrame([], "src string, type string, dst string"), embedder=model, vectors=held)
    assert [(r["entity_id"], r["score"]) for r in found.vector_hits.collect()] == [("faq:1", 1.0)]  # queries have their axes swapped


def test_best_documents_with_fewer_postings(spark, monkeypatch):
    from pyspark.sql import functions as F

    from statuta.operators import lexical

    monkeypatch.setattr(lexical, "SEED_POSTINGS", 40)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    text = lambda n: " ".join(rng.choices(["the", "of", "and"] + words, weights=[60, 40, 30] + [3 / (k + 1) for k in range(200)], k=n))
    docs = spark.createDataFrame([(f"{rng.choice(['law', 'faq'])}:{k}", text(rng.randrange(0, 60))) for k in range(500)] + [("law:same1", "w3 w7"), ("law:same2", "w3 w7")], "entity_id string, text string")
    asked = [(q, f"{text(12)} w{q} w{q + 50} none", rng.choice([None, ["law"]]), rng.choice([1, 3, 10, None])) for q in range(30)] + [(99, "w3 w7", None, 1), (98, "nothing", None, 3), (97, "", None, 3)]
    requests = spark.createDataFrame(asked, "query_id int, query string, source_types array<string>, n int")
    postings = lexical.postings(docs, F.col("text"))
    key = lambda df: sorted((r["query_id"], r["rank"], r["entity_id"], r["score"]) for r in df.collect())
    wanted = lexical.bm25(requests, postings, None).join(requests.select("query_id", "n"), "query_id").where("n is null or rank <= n")
    found = lexical.TopK(requests, postings, F.col("n"), lexical.corpus_stats(postings))
    assert key(found.hits) == key(wanted)
    work = found.work().agg(F.sum("postings"), F.sum("leading"), F.sum("candidates")).first()
    assert work[2] < work[1] < work[0]
    limited = found.work().join(requests.where("n is not null"), "query_id").agg(F.sum("postings"), F.sum("leading")).first()
    assert limited[1] < 0.7 * limited[0]


def test_nearest_documents_with_fewer_comparisons(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    near = lambda n: centres[rng.choice(6, n, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1])] + 0.15 * rng.standard_normal((n, 16))
    unit = lambda v: (v / np.where((s := np.linalg.norm(v, axis=1, keepdims=True)) > 0, s, 1))
    docs, asked = unit(near(700)), unit(near(40))
    docs[100:160] = docs[3]  # more equal ones than a block holds
    docs[5] = asked[4] = 0
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=int(k))
    vector = "places array<int>, weights array<double>"
    sparse = lambda v: (np.flatnonzero(v).tolist(), v[v != 0].tolist())
    facts = [(f"{('law', 'faq')[k % 2]}:{k:03}", [None, ["ALL"], ["IB"], []][k % 4] if k % 9 == 0 else ["ALL"], None if k % 5 == 0 else day(k), None if k % 3 else day(k + 300)) for k in range(700)]
    entities = spark.createDataFrame(facts, "entity_id string, allowed_depts array<string>, effective_date date, superseded_date date")
    vecs = spark.createDataFrame([(f[0], *sparse(v)) for f, v in zip(facts, docs)], f"entity_id string, {vector}")
    some = [(q, ["IB", "HR"][q % 2], None if q == 7 else day(rng.integers(0, 900)), [None, ["law"], []][q % 3] if q < 9 else None, [1, 5, 20, None][q % 4]) for q in range(40)]
    requests = spark.createDataFrame(some, "query_id int, dept string, as_of date, source_types array<string>, n int")
    query_vectors = spark.createDataFrame([(q, *sparse(v)) for q, v in enumerate(asked)], f"query_id int, {vector}")
    wanted = set()
    for (q, dept, at, types, n), v in zip(some, asked):
        score = np.round(docs @ v, 6)
        seen = [k for k, (e, d, b, s) in enumerate(facts) if at and d and ("ALL" in d or dept in d) and (b is None or b <= at) and (s is None or at < s) and (types is None or e[:3] in types) and score[k] >= 0.05]
        wanted |= {(q, facts[k][0], rank) for rank, k in enumerate(sorted(seen, key=lambda k: (-score[k], facts[k][0]))[:n], 1)}
    found = vectors.balls(requests, query_vectors, entities, vecs, F.col("n"), ball_rows=16, ring_rows=16, seed_rows=32)
    rows = vectors.within(vectors.ranked(found.hits)).collect()
    assert len(rows) == len(wanted) and {(r["query_id"], r["entity_id"], r["rank"]) for r in rows} == wanted
    sizes = [r["n"] for r in found.rings.collect()]
    assert sum(sizes) == 700 and max(sizes) <= 48
    work = found.met().join(requests.where("n is not null"), "query_id").agg(F.sum("met"), F.sum("total")).first()
    assert work[0] < 0.5 * work[1]
    whole = vectors.search(requests, query_vectors, entities, vecs, F.col("n"), dimensions=16).collect()
    assert {(r["query_id"], r["entity_id"], r["rank"]) for r in whole} == wanted
    none = vectors.balls(requests, query_vectors, entities.limit(0), vecs, F.col("n"), ball_rows=16)
    assert none.hits.count() == 0 and none.met().agg(F.sum("met"), F.max("total")).first()[:] == (0, 0)
    assert vectors.search(requests.limit(0), query_vectors, entities, vecs, None, dimensions=16).count() == 0
