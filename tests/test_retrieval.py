"""Retrieval, versions and graph over a small scenario of seven documents and some odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statuta.operators import graph, lexical, vectors, versions
from statuta.plans.retrieve import Retrieval, article_needles, overlap_rerank

D = dt.date
ENTITIES = "entity_id string, type string, title string, body string, effective_date date, superseded_date date, allowed_depts array<string>"
ROWS = [
    ("law:suit-v1", "law", "금융소비자법 제1조(적합성)", "적합성 원칙 고령 투자자 보호", D(2020, 1, 1), D(2023, 7, 1), ["ALL"]),
    ("law:suit-v2", "law", "금융소비자법 제1조(적합성)", "적합성 원칙 강화 고령 투자자 보호", D(2023, 7, 1), None, ["ALL"]),
    ("law:other", "law", "금융소비자법 제10조(설명)", "설명 의무", D(2020, 1, 1), None, ["ALL"]),
    ("regulation:guide", "regulation", "고령 투자자 지침", "고령 투자자 판매 절차", D(2023, 7, 15), None, ["ALL"]),
    ("interpretation:fsc", "interpretation", "유권해석", "적합성 해석", D(2023, 9, 1), None, ["ALL"]),
    ("case:sanction", "case", "제재사례", "적합성 위반 제재", D(2022, 11, 1), None, ["ALL"]),
    ("review:ib", "review", "검토서", "적합성 내부 검토 고령 투자자", D(2024, 3, 1), None, ["IB"]),
    ("faq:elderly", "faq", "고령 기준", "고령 투자자 기준은 무엇인가", None, None, ["ALL"]),
]
EDGES = [
    ("law:suit-v2", "supersedes", "law:suit-v1"),
    ("regulation:guide", "cites", "law:suit-v2"),
    ("interpretation:fsc", "interprets", "law:suit-v2"),
    ("case:sanction", "violates", "law:suit-v1"),
    ("review:ib", "cites", "regulation:guide"),
    ("faq:elderly", "answered_by", "regulation:guide"),
    ("faq:elderly", "cites", "law:missing"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, ENTITIES).cache(), spark.createDataFrame(EDGES, "src string, type string, dst string").cache()


REQUEST = "query_id int, query string, dept string, as_of date, top_k int, source_types array<string>"


def ask_all(spark, tables, *asked, **more):
    """The results of several requests (query and what differs from the defaults) in one run."""
    usual = {"dept": "RETAIL", "as_of": D(2024, 6, 1), "top_k": 6, "types": None}
    rows = [(k, query, *((usual | own)[c] for c in ("dept", "as_of", "top_k", "types"))) for k, (query, own) in enumerate(asked)]
    found = Retrieval(spark.createDataFrame(rows, REQUEST), *tables, **more).result.orderBy("query_id", "position").collect()
    return [[(r["entity_id"], r["reason"], r["score"]) for r in found if r["query_id"] == k] for k in range(len(rows))]


def ask(spark, tables, query, **own):
    return ask_all(spark, tables, (query, own))[0]


def test_version_follows_the_date(spark, tables):
    new, old = ({i for i, *_ in found} for found in ask_all(spark, tables, ("적합성 원칙", {}), ("적합성 원칙", {"as_of": D(2021, 1, 1)})))
    assert "law:suit-v2" in new and "law:suit-v1" not in new
    assert "law:suit-v1" in old and "law:suit-v2" not in old
    assert "case:sanction" in new and "case:sanction" not in old


def test_restricted_documents(spark, tables):
    plain, own = ({i for i, *_ in found} for found in ask_all(spark, tables, ("적합성 내부 검토", {}), ("적합성 내부 검토", {"dept": "IB"})))
    assert "review:ib" not in plain and "review:ib" in own
    with pytest.raises(Exception, match="department"):
        ask(spark, tables, "x", dept="")


def test_article_numbers_do_not_cross(spark, tables):
    found = {i: reason for i, reason, _ in ask(spark, tables, "제 1 조 내용")}
    assert found["law:suit-v2"] == "citation_match" and found.get("law:other") != "citation_match"
    needles = spark.sql("select '제1조와 제 20 조의 3, 제1조' as q").select(article_needles(F.col("q"))).first()[0]
    assert needles == ["제1조", "제20조의3"]


def test_order_by_authority_and_types(spark, tables):
    order = ["law", "regulation", "interpretation", "case", "review", "faq", "precedent"]
    every, some = ask_all(spark, tables, ("고령 투자자 적합성", {"dept": "IB"}), ("고령 투자자", {"types": ["faq"]}))
    ranks = [order.index(i.split(":")[0]) for i, *_ in every]
    assert ranks == sorted(ranks)
    assert {i.split(":")[0] for i, *_ in some} == {"faq"}


def test_minority_type_is_kept(spark):
    rows = [(f"regulation:{k}", "regulation", f"규정 {k}", "담보 담보 담보 대출", None, None, ["ALL"]) for k in range(8)] + [("law:1", "law", "은행법", "담보 대출 은행 업무 범위와 감독", None, None, ["ALL"])]
    pair = spark.createDataFrame(rows, ENTITIES), spark.createDataFrame([], "src string, type string, dst string")
    found = [i for i, *_ in ask(spark, pair, "담보 대출")]
    assert "law:1" in found and sum(i.startswith("regulation") for i in found) >= 6


def test_plugged_in_reranker(spark, tables):
    requests = spark.createDataFrame([(1, "고령 기준", "RETAIL", D(2024, 6, 1), 6, None)], REQUEST)
    run = Retrieval(requests, *tables, rerank=overlap_rerank(requests, tables[0]))
    best = run.base.orderBy("seq").first()
    assert best["entity_id"] == "faq:elderly" and best["score"] == 1.0


def test_chain_from_any_member_and_before_the_first(spark, tables):
    chains = {r["entity_id"]: r["chain_id"] for r in versions.chains(*tables).collect()}
    assert chains["law:suit-v1"] == chains["law:suit-v2"] == "law:suit-v1" and chains["law:other"] == "law:other"
    hits = spark.createDataFrame([("law:suit-v2", D(2019, 1, 1)), ("law:suit-v2", D(2021, 1, 1)), ("law:suit-v1", D(2024, 1, 1)), ("law:ghost", D(2024, 1, 1))], "entity_id string, as_of date")
    found = {(r["entity_id"], r["as_of"].year): r["resolved_id"] for r in versions.resolve(hits, tables[0], versions.chains(*tables)).collect()}
    assert found == {("law:suit-v2", 2021): "law:suit-v1", ("law:suit-v1", 2024): "law:suit-v2"}


def test_cyclic_chain(spark, tables):
    loop = spark.createDataFrame([("law:suit-v1", "supersedes", "law:other"), ("law:other", "supersedes", "law:suit-v1")], "src string, type string, dst string")
    assert versions.chains(tables[0], tables[1].union(loop)).where("chain_id = 'law:other'").count() == 3


def test_neighbours_out_before_in(spark, tables):
    near = [r["neighbour"] for r in graph.neighbours(tables[1], tables[0]).where("entity_id = 'regulation:guide'").orderBy("position").collect()]
    assert near == ["law:suit-v2", "faq:elderly", "review:ib"]


def test_empty_index(spark, tables):
    none = tables[0].limit(0), tables[1].limit(0)
    assert ask(spark, none, "적합성") == []
    assert lexical.corpus_stats(lexical.postings(none[0], F.col("body"))).first()["n_docs"] == 0


def test_hash_vectors(spark):
    rows = vectors.hash_embed(spark.createDataFrame([("a", "가나다"), ("b", "x"), ("c", "")], "id string, t string"), F.col("t"), "id").collect()
    assert {r["id"] for r in rows} == {"a", "b", "c"} and abs(sum(r["w"] ** 2 for r in rows if r["id"] == "a") - 1) < 1e-9


def test_user_model(spark):
    docs = spark.createDataFrame([(str(k), "ab" * k) for k in range(25)], "entity_id string, text string")
    found = {r["entity_id"]: r["embedding"] for r in vectors.embed_with(docs, lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert found["7"] == [14.0] and len(found) == 25
