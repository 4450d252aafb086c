"""Text, citation, article, file, contract and guard functions on single cases."""

import datetime as dt

from pyspark.sql import functions as F

from statuta.functions import korean
from statuta.functions.predicates import depts_from_text, parse_source_types, type_from_id
from statuta.functions.text import char_ngrams, mask_pii, tokens
from statuta.operators import contracts, guard, state
from statuta.sources import crawl, files, pages


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_tokens(spark):
    assert one(spark, "투자자 보호 Art 12-b réaux", tokens) == ["투자자", "투자", "자자", "보호", "보호", "art", "12", "b", "r", "aux"]
    assert one(spark, "", tokens) == []


def test_char_ngrams(spark):
    assert sorted(one(spark, "Ab c", char_ngrams)) == sorted(["ab", "b ", " c", "ab ", "b c"])
    assert one(spark, "x", char_ngrams) == ["x"] and one(spark, "", char_ngrams) == [""]
    assert sorted(one(spark, "a😀b", char_ngrams)) == sorted(["a😀", "😀b", "a😀b"])


def test_masks(spark):
    masked = one(spark, "홍@회사.kr 900101-1234567 010-1234-5678 110-234-567890 2024-01-02", mask_pii)
    assert masked == "[이메일 마스킹] [주민번호 마스킹] [전화번호 마스킹] [계좌번호 마스킹] [계좌번호 마스킹]"


def test_same_law(spark):
    df = spark.createDataFrame([("a", "동법 제9조, 「은행법」 제1조, 동법 제2조의3 및 자본시장법 제4조, 같은  법 제5조")], "id string, x string")
    found = [(r["law_name"], r["jo"], r["jo_br"]) for r in korean.law_citations(df, F.col("x"), "id").orderBy("pos").collect()]
    assert found == [("은행법", "1", None), ("은행법", "2", "3"), ("자본시장법", "4", None), ("자본시장법", "5", None)]


def test_articles(spark):
    text = "머리말\n제1조(목적) 하나\n본문 제2조 인용\n제3조의2 ( 정의 ) 둘\n부 칙\n시행"
    found = [(a["label"], a["body"]) for a in one(spark, text, korean.split_articles)]
    assert found == [("제1조(목적)", "제1조(목적) 하나\n본문 제2조 인용"), ("제3조의2(정의)", "제3조의2 ( 정의 ) 둘\n\n부 칙\n시행")]
    assert one(spark, "no headings", korean.split_articles) == []


def test_titles_dates_ids(spark):
    assert one(spark, "\n-----\n  규정 제목 \n", korean.doc_title) == "규정 제목" and one(spark, "--\n", korean.doc_title) == "제목 없음"
    assert one(spark, "제정 2001.2.3 개정 2020-13-01 개정 2019. x", korean.latest_revision) == dt.date(2001, 2, 3)
    assert one(spark, "12. 가나 (b)", korean.external_id) == "12" and one(spark, "가나 다(B)", korean.external_id) == "가나-다-b"
    assert one(spark, "IB/a/b.docx", korean.dept_from_path) == ["IB"] and one(spark, "b.docx", korean.dept_from_path) == ["ALL"]
    assert one(spark, " 2024-02-30", korean.coerce_date) is None and one(spark, "20240229", korean.compact_date) == dt.date(2024, 2, 29)


def test_small_predicates(spark):
    assert one(spark, "law:1", type_from_id) == "law" and one(spark, "lawless", type_from_id) is None and one(spark, "x:1", type_from_id) is None
    assert one(spark, None, depts_from_text) == ["ALL"] and one(spark, "A,B", depts_from_text) == ["A", "B"]
    assert one(spark, None, lambda _: parse_source_types(F.array(F.lit(" LAW "), F.lit("zzz"), F.lit("law")))) == ["law"]
    assert one(spark, None, lambda _: parse_source_types(F.array(F.lit("zzz")))) is None


def test_files(spark):
    rows = spark.createDataFrame([("IB/1. a.docx", "규정\n제정 2020.1.2\n제1조(목적) x"), ("b.docx", "글")], "path string, text string")
    found = {r["entity_id"]: r for r in files.article_documents(rows).collect()}
    assert found["regulation:1-1"]["title"] == "규정 제1조(목적)" and found["regulation:1-1"]["allowed_depts"] == ["IB"]
    assert found["regulation:b"]["body"] == "글"


def test_clauses_and_checklists(spark):
    rows = spark.createDataFrame([("c", "제1조(손해배상 및 해지) x\n제2조(기타) y"), ("d", "whole")], "contract_id string, text string")
    found = contracts.clauses(rows).select("contract_id", "label", contracts.checklist(F.col("label")).alias("k")).collect()
    assert {(r["contract_id"], r["k"]) for r in found} == {("c", "damages"), ("c", "default"), ("d", "default")}
    assert {r["label"] for r in found} >= {"전체 본문"}


def test_guard(spark):
    answers = spark.createDataFrame([("a", "x [[CITE:law:2]] y [[CITE:ghost]] [[CITE:law:1]] [[CITE:law:2]]"), ("b", "plain"), ("c", "[[CITE:law:1]]")], "answer_id string, text string")
    had = spark.createDataFrame([("a", "law:1"), ("a", "law:2"), ("a", "ghost")], "answer_id string, entity_id string")
    known = spark.createDataFrame([("law:1", "One"), ("law:2", "Two")], "entity_id string, title string")
    found = {r["answer_id"]: r for r in guard.verify(answers, had, known).collect()}
    assert found["a"]["text"] == "x [1] y [출처 미확인] [2] [1]\n\n---\n**참고 문서**\n[1] Two (law:2)\n[2] One (law:1)"
    assert found["a"]["verified"] == ["law:2", "law:1"] and found["a"]["rejected"] == ["ghost"]
    assert found["b"]["text"] == "plain" and found["c"]["rejected"] == ["law:1"]


def test_quarantine_and_edges(spark):
    rows = spark.createDataFrame([('{"id":"1","title":"t","body":"b","supersedes":["law:a","law:b"]}',), ('{"id":"2","title":"t","body":"b","effective_date":"2024-99-99"}',), ('{"id":"3","body":"b"}',), ("{",), ('{"id":"4","title":"t","body":"b","relations":[["knows","x"]]}',), ('{"id":"5","title":"t","body":"b","supersedes":"law:c"}',)], "value string")
    parsed = crawl.parse(rows)
    assert sorted(r["reason"] for r in parsed.where("reason is not null").collect()) == ["bad date", "missing id", "missing title", "unknown relation"]
    assert {(r["src"], r["dst"]) for r in crawl.convenience_edges(parsed, "law").collect()} == {("law:1", "law:a"), ("law:1", "law:b"), ("law:5", "law:c")}
    assert crawl.convenience_edges(parsed, "faq").count() == 0


def test_sync_rules(spark):
    pair = "source string, entity_id string"
    known = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "9")], pair)
    now = spark.createDataFrame([("a", "1"), ("a", "3"), ("c", "8")], pair)
    status = spark.createDataFrame([("a", None, None), ("b", "down", None), ("c", None, "bad")], "source string, fetch_error string, ingest_error string")
    report = state.sync_report(known, now, status)
    assert {(r["source"], r["ingested"], r["removed"], r["ok"]) for r in report.collect()} == {("a", 2, 1, True), ("b", 0, 0, False), ("c", 0, 1, False)}
    assert {tuple(r) for r in state.next_state(known, now, report).collect()} == {("a", "1"), ("a", "3"), ("b", "1"), ("c", "9")}
    again = state.sync_report(now, now, status.where("source = 'a'")).first()
    assert again["removed"] == 0


def test_stream(spark, tmp_path):
    from statuta.streaming import sync

    for ids in (["1", "2"], ["2", "3"]):
        spark.createDataFrame([("s", i) for i in ids], "source string, entity_id string").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        feed = spark.readStream.schema("source string, entity_id string").parquet(str(tmp_path / "feed"))
        sync.stream_sync(spark, feed, str(tmp_path / "out")).awaitTermination()
        held = sync.store(spark, str(tmp_path / "out"), feed).snapshot()
        assert {r["entity_id"] for r in held.table("state").collect()} == set(ids)
    assert [(r["batch"], r["entity_id"]) for r in held.table("removed").collect()] == [(1, "1")]


def test_versions_of_articles(spark):
    rows = spark.createDataFrame([("L", "법", 1, 0, "제1조", "b", dt.date(2020, 1, 1), True, "제1조", "n", dt.date(2024, 1, 1)), ("L", "법", 2, 0, "제2조", "b", dt.date(2020, 1, 1), True, "t", "n", None)], "law_id string, law_name string, jo_no int, jo_br_no int, title string, body string, effective_date date, upcoming boolean, upcoming_title string, upcoming_body string, upcoming_date date")
    found = {r["id"]: r for r in pages.versioned_items(rows).collect()}
    assert set(found) == {"L-1-0@2020-01-01", "L-1-0@2024-01-01", "L-2-0@2020-01-01"}
    assert found["L-1-0@2024-01-01"]["supersedes"] == "law:L-1-0@2020-01-01" and found["L-1-0@2020-01-01"]["superseded_date"] == dt.date(2024, 1, 1)


def test_spaces_and_digits_are_those_of_python(spark):
    import re
    import sys

    from statuta.functions import text

    odd = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace() and re.fullmatch(r"\s", chr(c))]
    near = ["​", "᠎", "﻿", "\x1b", "\x21", "\x84", "⁠", "a"]
    rows = spark.createDataFrame([(c, f"{c}x{c}y{c}{c}") for c in odd + near] + [("all", "".join(odd) + "x" + "".join(odd)), ("none", "".join(odd))], "c string, t string")
    for r in rows.select("c", "t", text.strip(F.col("t")).alias("s"), F.col("c").rlike(f"^{text.SPACE}$").alias("space")).collect():
        assert r["s"] == r["t"].strip(), ascii(r["c"])
        assert len(r["c"]) > 1 or r["c"] == "\n" or r["space"] == bool(re.fullmatch(r"\s", r["c"])), ascii(r["c"])
    assert len(text.DIGITS) == len(text.ASCII_DIGITS) and spark.range(1).select(text.ascii_digits(F.lit("２０２4-٠٣-१"))).first()[0] == "2024-03-1"


def test_citations_between_odd_spaces(spark):
    from statuta.functions import korean

    rows = spark.createDataFrame([(1, "자본시장법 제3조, 같은　법 제 ４ 조 의 2 및 동법 제5조")], "id int, t string")
    found = [(r["law_name"], r["jo"], r["jo_br"], r["explicit"]) for r in korean.law_citations(rows, F.col("t"), "id").orderBy("pos").collect()]
    assert found == [("자본시장법", "3", None, True), ("자본시장법", "４", "2", False), ("자본시장법", "5", None, False)]
    title = spark.createDataFrame([("　---   규정 이름　\x1e둘째",)], "t string").select(korean.doc_title(F.col("t"))).first()[0]
    assert title == "규정 이름"
