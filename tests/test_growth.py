"""What a step shuffles or holds must not grow faster than its input."""

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from statuta.functions.text import gram_counts
from statuta.operators import vectors

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def shuffles(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate(keys" in line]


def test_grams_are_added_up_by_gram_alone(spark):
    rows = spark.createDataFrame([(1, "abab"), (2, "ab"), (3, None), (4, "")], "doc_id int, text string")
    found = gram_counts(rows, F.col("text"))
    assert {tuple(r) for r in found.collect()} == {("ab", 3, 2), ("ba", 1, 1), ("aba", 1, 1), ("bab", 1, 1), ("", 1, 1)}
    assert "doc_id" not in "".join(shuffles(entry.queries()["char_ngrams"](spark, SF)))


def test_idf_shuffles_no_posting(spark):
    keys = shuffles(entry.queries()["idf"](spark, SF))
    assert keys and not any("entity_id" in line for line in keys)


def test_duplicate_ids_leave_texts_behind(spark):
    assert "제정" not in plan(entry.queries()["duplicate_ids"](spark, SF))


def test_a_model_s_rows_go_on_in_parts():
    batch = pa.RecordBatch.from_pydict({"id": list(range(2500)), "text": ["x"] * 2500})
    asked = []
    parts = list(vectors._modelled([batch], lambda texts: asked.append(len(texts)) or [[1.0]] * len(texts), 64))
    assert [len(ids) for ids, _ in parts] == [len(found) for _, found in parts] == [1000, 1000, 500]
    assert sum(asked) == 2500 and max(asked) == 64


def test_best_ranks_without_fusing_all(spark):
    """Where few first ranks are not enough to be sure, all hits of the request are fused."""
    from statuta.plans.queries_retrieval import retrieval

    run = retrieval(spark, SF, unlimited=True)
    whole = {r["query_id"]: r["n"] for r in run.pool.where("type = 'law'").groupBy("query_id").agg(F.min("pool_rank").alias("n")).collect()}
    for probe in (1, 40):
        assert {r["query_id"]: r["true_rank"] for r in run.best_ranks("law", probe).collect()} == whole


def test_title_substrings_has_a_row_a_query(spark):
    """Pairs of needles and titles would grow with the square of the rows."""
    found = entry.queries()["title_substrings"](spark, SF).collect()
    assert len(found) == len({r["doc_id"] for r in found}) and all(r["doc_id"] % 50 == 0 for r in found)


def test_texts_are_searched_without_postings(spark, monkeypatch):
    """Ties, widths, types and blocks of a text search against all scores over the postings; no posting is shuffled."""
    from statuta.operators import lexical

    for name, size in (("QUERY_BLOCK", 3), ("DOC_BLOCK", 40), ("CELLS", 60)):
        monkeypatch.setattr(lexical, name, size)
    rows = [(f"{('law', 'faq')[k % 2]}:{k}", " ".join(["담보대출 Loan"] * (k % 3) + [f"w{k % 7}", f"x{k}"]) if k % 11 else "?!") for k in range(150)]
    docs = spark.createDataFrame(rows, "entity_id string, text string")
    asked = [(q, ["담보 w1 w2", "loan x5", "없는 말", "W3 대출 w3", None][q % 5], [None, ["faq"], [], ["law", "faq"]][q % 4], [1, 5, 60, None][q % 4 if q < 16 else 1]) for q in range(20)]
    requests = spark.createDataFrame(asked, "query_id int, query string, source_types array<string>, n int")
    key = lambda df: sorted((r["query_id"], r["rank"], r["entity_id"], r["score"]) for r in df.collect())
    wanted = lexical.bm25(requests, lexical.postings(docs, F.col("text")), None).join(requests.select("query_id", "n"), "query_id").where("n is null or rank <= n")
    for most in (50_000, 2):  # with more asked terms than that, documents keep all of their terms
        monkeypatch.setattr(lexical, "MOST_ASKED", most)
        assert key(lexical.TextSearch(requests, docs, F.col("text"), F.col("n")).hits) == key(wanted)
    assert not any("entity_id" in line for line in shuffles(lexical.postings(docs, F.col("text"))))


def test_grams_in_a_table_or_sorted(monkeypatch):
    texts = ["", "a", "😀", "ab", "가나다 ab😀ab", "aaaa", "x" * 300 + "가"]
    table = vectors._gram_sums(texts)
    monkeypatch.setattr(vectors, "GRAM_CELLS", 0)
    assert (table == vectors._gram_sums(texts)).all() and table[5].tolist() == [3 * x + 2 * y for x, y in zip(vectors._gram_sums(["aa"])[0], vectors._gram_sums(["aaa"])[0] - 2 * vectors._gram_sums(["aa"])[0])]


def test_sync_does_not_deal_texts_by_origin(spark, tmp_path, monkeypatch):
    """There are few origins, so a task would get all texts of one."""
    from statuta.operators import knowledge

    plans, cut = [], knowledge.cut
    monkeypatch.setattr(knowledge, "cut", lambda df: ("body" in df.columns and plans.append(df._jdf.queryExecution().sparkPlan().toString())) or cut(df))
    docs = spark.createDataFrame([(f"faq:{k}", "faq", "t", f"b {k}", None, None, ["ALL"], "s", "ab"[k % 2]) for k in range(4)], f"{knowledge.ENTITIES}, origin string")
    status = spark.createDataFrame([("b", "down")], "origin string, fetch_error string")
    held = knowledge.KnowledgeTables(spark, f"file://{tmp_path}/kb")
    report = {r["origin"]: (r["added"], r["ok"]) for r in held.sync(docs, spark.createDataFrame([], knowledge.EDGES), status).collect()}
    assert report == {"a": (2, True), "b": (0, False)}
    joins = [line for p in plans for line in p.splitlines() if "LeftAnti" in line]
    assert joins and all("Broadcast" in line for line in joins if "origin" in line)


def test_a_cache_of_vectors_is_read_once(spark):
    """The model sees what makes up the cache and what that lacks, each text once."""
    seen = spark.sparkContext.accumulator(0)
    model = vectors.Embedder("m", 2, lambda texts: seen.add(len(texts)) or [[float(len(t)), 0.0] for t in texts], batch=2)
    docs = spark.createDataFrame([(f"faq:{k}", "t", "b" * k, ["ALL"]) for k in range(6)] + [(None, "t", "b", None)], "entity_id string, title string, body string, allowed_depts array<string>")
    older = docs.where("entity_id <> 'faq:5'").withColumn("body", F.when(F.col("entity_id") == "faq:4", "old").otherwise(F.col("body")))
    found = model.document_vectors(docs, model.document_vectors(older), "allowed_depts").collect()
    assert sorted((r["entity_id"], *r["places"], *r["weights"], *r["allowed_depts"]) for r in found) == [(f"faq:{k}", 0, 1, 1.0, 0.0, "ALL") for k in range(6)]
    assert seen.value == 5 + 2


def test_titles_are_searched_once(spark):
    from statuta.plans.queries_retrieval import retrieval

    run, seen = retrieval(spark, SF), spark.sparkContext.accumulator(0)
    wanted = {tuple(r) for r in run.cited.collect()}
    rows = run.entities.withColumn("title", F.udf(lambda t: seen.add(1) or t).asNondeterministic()("title"))
    assert {tuple(r) for r in replace(run, entities=rows).cited.collect()} == wanted and wanted
    assert seen.value == rows.count()


def test_a_title_does_not_cut_the_text_into_words(spark):
    from statuta.sources import adapter

    rows = adapter.entities(spark, SF)
    assert "split" not in plan(rows)
    words = adapter.read(spark, SF, "documents").select("doc_id", F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)).alias("word"))
    assert rows.join(words, "doc_id").where(~F.col("title").endswith(F.concat(F.lit("조("), "word", F.lit(")")))).isEmpty()


def test_words_are_found_in_bytes(spark):
    """Scripts beside Hangul, parts of a table and neighbouring texts; no term of a text search is a string."""
    from statuta.functions.text import tokens
    from statuta.operators import lexical

    texts = ["", "a", "가", "", "가나다 ab9가나😀힣", "각가\n가각", "ꯣ가힤ㄱ나é ß x９y", "_z", "나"]
    words, row = lexical._words(pa.array(["z나", *texts, "가z"]).slice(1, len(texts)))
    found = sorted(zip(row.tolist(), words.to_pylist()))
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", F.explode(tokens(F.col("text"))))
    assert found == sorted(map(tuple, rows.collect()))
    docs = spark.createDataFrame([("faq:1", "가나 ab x")], "entity_id string, text string")
    asked = spark.createDataFrame([(1, "나 가나 AB", None)], "query_id int, query string, source_types array<string>")
    search = lexical.TextSearch(asked, docs, F.col("text"), F.lit(5))
    kept = search.counted.first()
    assert kept["doc_len"] == 4 and [(search.numbered[t].as_py(), n) for t, n in sorted(zip(kept["terms"], kept["tfs"]), key=lambda x: search.numbered[x[0]].as_py())] == [("ab", 1), ("가나", 2)]


def test_ranks_without_writing_hits(spark, monkeypatch):
    """Leading hits and ranks of any hit against all hits, in slices of a few rows, requests and pairs, with many ties."""
    from statuta.operators import lexical, ranks

    for name, size in (("ASKED_SLICE", 2), ("ROWS_SLICE", 7), ("MOST_LISTED", 50)):
        monkeypatch.setattr(ranks, name, size)
    rows = [(f"{('law', 'faq')[k % 2]}:{k}", " ".join(["loan"] * (k % 3) + [f"w{k % 7}"] + ["x"] * (k % 2)) if k % 11 else "") for k in range(90)]
    docs = spark.createDataFrame(rows, "entity_id string, text string")
    requests = spark.createDataFrame([(1, "loan w1 w2", None), (2, "x loan", ["faq"]), (3, "w3", []), (4, "none", None), (5, "w5 x", ["law", "faq"])], "query_id int, query string, source_types array<string>")
    hits = [tuple(r) for r in lexical.bm25(requests, lexical.postings(docs, F.col("text")), None).select("query_id", "entity_id", "rank").collect()]
    channel = lexical.TextSearch(requests, docs, F.col("text"), None).channel
    every = {q: [x for x in hits if x[0] == q] for q in (1, 2, 5)}
    for least in (1, 5, 90):
        found, depth = channel.leading(requests.where("query_id <> 5"), F.lit(least))
        found = {tuple(r) for r in found.select("query_id", "entity_id", "rank").collect()}
        known = {r["query_id"]: (r["depth"], r["total"]) for r in depth.collect()}
        assert set(known) == {1, 2} and all(n == len(every[q]) and min(least, n) <= d for q, (d, n) in known.items())
        assert found == {x for q in (1, 2) for x in every[q] if x[2] <= known[q][0]}
    pairs = [(q, i) for q in range(1, 6) for i, _ in rows if (q + int(i.split(":")[1])) % 3]
    asked = spark.createDataFrame(pairs, "query_id int, entity_id string")
    assert sorted(map(tuple, channel.ranks(asked).collect())) == sorted(x for x in hits if x[:2] in set(pairs))


def test_diagnosis_does_not_write_all_hits(spark):
    """Hits of a run without a width are as many as requests times documents."""
    from statuta.plans.queries_retrieval import retrieval

    run = retrieval(spark, SF, unlimited=True)
    narrow, whole = run.limited(), retrieval(spark, SF)
    few = {tuple(r) for r in narrow.hits.select("query_id", "entity_id", "rank", "reason").collect()}
    assert few == {tuple(r) for r in whole.channel_hits.select("query_id", "entity_id", "rank", "reason").collect()}
    found, spare = run._leading(1, run.requests)
    assert found.count() < run.requests.count() * 200 and not spare.isEmpty()
    run.best_ranks("law", 8).collect()
    assert "channel_hits" not in run.__dict__ and "pool" not in run.__dict__


def test_diagnosis_ends_without_a_document_of_the_type(spark):
    """Requests that can see none are done at once; those whose chain of the type comes late go on with more hits."""
    from datetime import date as day

    from statuta.plans.retrieve import Retrieval

    docs = [(f"faq:{k}", "faq", "t", "loan " * 3 + f"w{k}", day(2020, 1, 1), None, ["ALL"], "s") for k in range(60)]
    docs += [("law:1", "law", "t", "loan " + "other " * 30, day(2021, 1, 1), None, ["IB"], "s"), ("law:2", "law", "t", "nothing", day(2020, 1, 1), None, ["WM"], "s")]
    entities = spark.createDataFrame(docs, "entity_id string, type string, title string, body string, effective_date date, superseded_date date, allowed_depts array<string>, source string")
    edges = spark.createDataFrame([("faq:2", "supersedes", "faq:1")], "src string, type string, dst string")
    asked = [(1, "loan", "IB", day(2022, 1, 1), 1, None), (2, "loan", "IB", day(2020, 6, 1), 1, None), (3, "loan", "WM", day(2022, 1, 1), 1, None), (4, "loan", "IB", day(2022, 1, 1), 1, ["faq"])]
    requests = spark.createDataFrame(asked, "query_id int, query string, dept string, as_of date, top_k int, source_types array<string>")
    run = Retrieval(requests, entities, edges, unlimited=True)
    assert {r["query_id"] for r in run._may_find("law").collect()} == {1, 3}
    whole = {r["query_id"]: r["n"] for r in run.pool.where("type = 'law'").groupBy("query_id").agg(F.min("pool_rank").alias("n")).collect()}
    assert {r["query_id"]: r["true_rank"] for r in run.best_ranks("law", 1).collect()} == whole == {1: 60}


def test_title_substrings_finds_every_pair(spark):
    """The needle of every third document, whether found in one title or in all, with each title that contains it."""
    from statuta.sources import adapter

    titles = {r["doc_id"]: (r["entity_id"], r["title"]) for r in adapter.entities(spark, SF).select("doc_id", "entity_id", "title").collect()}
    needles = {k: t[k % 9 : k % 9 + k // 3 % 40 + 1] for k, (_, t) in titles.items() if k % 3 == 0}
    needles = {k: n[::-1] if k % 4 == 3 else n for k, n in needles.items() if n}
    expected = sorted((k, n, i) for k, n in needles.items() for i, t in titles.values() if n in t)
    assert sorted(map(tuple, entry.queries()["title_substrings"](spark, SF).collect())) == expected and len(expected) > len(needles)


def test_a_needle_that_many_have_is_not_one_task_s(spark):
    from statuta.operators.titles import SALTS, title_matches

    needles = spark.createDataFrame([(k, "법" if k % 2 else ["", None, "none", "법 제1"][k % 4]) for k in range(40)], "k int, needle string")
    titles = spark.createDataFrame([(f"law:{k}", "law", f"법 제{k}" if k % 5 else None) for k in range(50)], "entity_id string, type string, title string")
    pairs = title_matches(needles, titles)
    found = sorted(map(tuple, pairs.select("k", "needle", "entity_id", "title").collect()))
    assert found == sorted((r["k"], r["needle"], t["entity_id"], t["title"]) for r in needles.collect() if r["needle"] for t in titles.collect() if t["title"] and r["needle"] in t["title"])
    assert SALTS > 1 and pairs.columns == ["needle", "k", "entity_id", "type", "title"]
    first = next(line for line in plan(pairs).splitlines() if "Join Inner" in line)
    assert "needle" in first and "salt" in first
