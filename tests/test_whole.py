"""Searches do their whole job: whole request texts, all vectors, no width; against brute force on small tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from statuta.operators import lexical, vectors
from statuta.plans import queries_retrieval as Q
from statuta.sources import adapter

TAIL = " ".join(f"filler{k}" for k in range(20))
ITEMS = [(1, f"{TAIL} needle"), (2, None), (3, f"{TAIL} 제3조 straw"), (4, "short")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    docs = [(k, f"word{k} " + ("needle " * (k % 5) if k % 3 == 0 else "straw hay"), "en", "s", 20) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def words(text):
    out = []
    for w in re.findall("[가-힣]+|[0-9a-zA-Z]+", text.lower()):
        out += [w, *(w[i : i + 2] for i in range(len(w) - 1))] if re.fullmatch("[가-힣]{2,}", w) else [w]
    return out


def test_requests_are_whole_texts(spark, folder):
    found = {r["query_id"]: r["query"] for r in adapter.requests(spark, folder).collect()}
    assert found == {k: (t or "") + (f" 제{k % 14 + 1}조" if k % 2 == 0 else "") for k, t in ITEMS}
    needles = {r["query_id"]: r["needles"] for r in Q.REGISTRY.queries["article_needles"](spark, folder).collect()}
    assert needles == {1: "", 2: "제3조", 3: "제3조", 4: "제5조"}


def test_bm25_over_whole_requests(spark, folder):
    docs = {r["entity_id"]: words(f"{r['title']}\n{r['body']}") for r in adapter.entities(spark, folder).collect()}
    mean, df = np.mean([len(w) for w in docs.values()]), Counter(t for w in docs.values() for t in set(w))
    expected = set()
    for r in adapter.requests(spark, folder).collect():
        scores = {}
        for i, own in docs.items():
            tf = Counter(own)
            hit = [math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(own) / mean)) for t in set(words(r["query"])) if t in tf]
            if hit:
                scores[i] = round(sum(hit), 6)
        expected |= {(r["query_id"], i, round(scores[i], 4)) for i in sorted(scores, key=lambda i: (-scores[i], i))[:30]}
    found = {(r["query_id"], r["entity_id"], round(r["score"], 4)) for r in Q.bm25_search(spark, folder).collect()}
    assert found == expected and {1, 3} <= {q for q, *_ in found}


@pytest.mark.parametrize("blocks", [(1024, 4096), (2, 7)])
def test_dense_search_over_all_labels(spark, tmp_path, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", blocks[0], raising=False)
    monkeypatch.setattr(vectors, "ROW_BLOCK", blocks[1], raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(3)
    data = {k: rng.standard_normal(8).astype(np.float32) for k in range(260)}
    data[50] = data[7] + np.float32(1e-3)
    for k in (101, 102, 103, 104, 105, 106, 107, 108):
        data[k] = data[100]
    data[9], data[200] = np.zeros(8, np.float32), np.zeros(8, np.float32)
    rows = [(k, v.tolist(), None if k % 4 == 3 else k % 3) for k, v in data.items()]
    odd = [(300, None, 1), (301, [1.0, None] * 4, 1), (302, [1.0] * 5, 1), (303, [], None), (None, [1.0] * 8, 1)]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    expected = set()
    for q in (0, 50, 100, 150, 250):
        cos = lambda v, w: float(v.astype(float) @ w.astype(float) / max(np.linalg.norm(v.astype(float)) * np.linalg.norm(w.astype(float)), 1e-30))
        score = {k: round(cos(data[q], v), 6) for k, v in data.items() if k != q}
        order = sorted((k for k in score if score[k] >= 0.05), key=lambda k: (-score[k], k))[:6]
        expected |= {(q, k, round(score[k], 4), n) for n, k in enumerate(order, 1)}
    found = Q.vector_search_dense(spark, str(tmp_path)).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["query_id"], r["vec_id"], round(r["score"], 4), r["rank"]) for r in found} == expected
    assert (50, 7) in {(r["query_id"], r["vec_id"]) for r in found}


def test_diagnosis_has_no_width(spark, folder, monkeypatch):
    runs = []
    monkeypatch.setattr(Q, "diagnose", lambda narrow, wide: runs.extend([narrow, wide]))
    Q.recall_diagnosis(spark, folder)
    assert runs[0].recall_width is not None and runs[1].recall_width is None
    asked = adapter.requests(spark, folder)
    every = lexical.bm25(asked, Q.posts(spark, folder), None).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in every}[3] == 60
