"""Very long texts, repeated rows, clashing columns and odd ids, and the pipeline stage by stage against brute force."""

import hashlib
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
llm = pytest.importorskip("statuta.llm.queries")
from statuta.llm import bpe, langid, packing, quality, simhash, substring_dedup, toxicity  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_texts_of_megabytes(spark):
    import tiktoken

    long = "".join(f"word{k % 977} é{k % 13}, " for k in range(150_000))
    rows = spark.createDataFrame([(1, long), (2, "x" * 1_500_000), (3, "short text.")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    found = {r["doc_id"]: r for r in collected(bpe.encode(rows.where("doc_id <> 2"), path, public_tokenizers.PATTERN, with_decoded=True))}
    ids = own.encode_ordinary(long)
    assert found[1]["n_tokens"] == len(ids) and hashlib.sha256(found[1]["ids"]).digest() == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).digest() and bytes(found[1]["decoded"]) == long.encode()
    judged = {r["doc_id"]: r for r in collected(quality.judge(rows.withColumn("lang", F.lit("en"))))}
    assert judged[1]["n_words"] == 300_000 and judged[1]["word_chars"] == len(long) - 300_000 and judged[2]["n_words"] == 1 and judged[2]["word_chars"] == 1_500_000
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    scores = collected(toxicity.score(rows, toxicity.fit(rows, labels, F.lit(True))))
    assert sorted(r["doc_id"] for r in scores) == [1, 2, 3] and all(0 <= r["score"] <= 1 for r in scores)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(k % 12, f"{'guter satz hier und dort' if k % 2 else 'a fine line here and there'} {k % 6}", "de" if k % 2 else "en", "s", 1, 2, "y", "t") for k in range(36)] + [(None, None, None, None, None, None, None, None), (None, "ein satz", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, fold int, weight int, y string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] * 2, "doc_id long, toxic int")
    scored = collected(toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))))
    assert sorted(str(r["doc_id"]) for r in scored) == sorted(str(r[0]) for r in rows)
    found = collected(langid.predict(docs, langid.fit(docs, F.lit(True))))
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    assert {(r["doc_id"] % 2, r["lang_pred"]) for r in found if r["doc_id"] is not None} == {(0, "en"), (1, "de")}


def test_ids_that_are_no_numbers(spark):
    passage = " ".join(f"w{k}" for k in range(40))
    rows = spark.createDataFrame([("abc", passage), ("7", passage), ("3", passage), (None, passage), ("5", "x")], "doc_id string, text string")
    found = {r["doc_id"]: r["n_removed"] for r in collected(substring_dedup.remove_repeats(rows))}
    assert found == {"abc": 0, "7": 40, "3": 0, None: 0, "5": 0}


def test_few_partitions_hold_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2_000)
    rng = np.random.default_rng(3)
    shared = [" ".join(f"s{i}w{k}" for k in range(30)) for i in range(5)]
    rows = [(k, " ".join([*(f"u{k}x{j}" for j in range(60)), shared[k % 5], *(f"v{rng.integers(50)}" for _ in range(40))])) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for d, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    for r in collected(substring_dedup.remove_repeats(docs)):
        w = rows[r["doc_id"]][1].split()
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r["doc_id"] for j in range(k, k + 13)}
        assert r["n_removed"] == len(gone) and r["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone)


def test_pipeline_stages_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    near = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 5000)
    odd = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "12 34 !", "en", "s", 7), (9004, "the of and a long text. " * 40_000, "en", "s", 1), (9004, "the of and a long text. " * 40_000, "en", "s", 1), (None, "the same text of some words without an id", "en", "s", 3)]
    docs = docs.union(near).union(spark.createDataFrame(odd, docs.schema)).withColumn("extra", F.lit(1)).withColumn("h", F.lit("x"))
    kept = pipeline.language_id(spark, docs, d).cache()
    ids = [r["doc_id"] for r in collected(kept)]
    assert not {9001, 9002, 9003} & set(ids) and ids.count(9004) == 2 and None in ids and len(ids) > 0.95 * docs.count()

    once = pipeline.simhash_dedup(spark, kept, d).cache()
    rows = [(r["doc_id"], r["text"], r["fingerprint"]) for r in collected(simhash.near_duplicates(kept.select(F.struct("doc_id", "text").alias("doc_id"), "text")).select("doc_id.doc_id", "doc_id.text", "fingerprint"))]
    prints = [int(r[2], 16) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    wanted = {min(r[0] for r, g in zip(rows, group) if g == k and r[0] is not None) for k in set(group) if any(r[0] is not None for r, g in zip(rows, group) if g == k)}
    found = [r["doc_id"] for r in collected(once)]
    assert sorted(x for x in found if x is not None) == sorted(wanted) and found.count(None) == 1

    cut = pipeline.substring_dedup_stage(spark, once, d).cache()
    texts, first = {r["doc_id"]: r["text"] for r in collected(once) if r["doc_id"] is not None}, {}
    for doc, t in texts.items():
        w = re.findall(WORD, t)
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(doc, first.get(tuple(w[k : k + 13]), doc))
    left = {r["doc_id"]: r["text"] for r in collected(cut)}
    for doc, t in texts.items():
        w = re.findall(WORD, t)
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < doc for j in range(k, k + 13)}
        rest = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert left.get(doc) == (t if not gone else rest or None), doc

    clean = pipeline.secret_scan(spark, cut, d).cache()
    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    kinds = [(assign, lambda m: len(m[1]) >= 6), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    after = {r["doc_id"]: r["text"] for r in collected(clean)}
    assert set(after) == set(left)
    for doc, t in left.items():
        secret = [m[0] for p, fits in kinds for m in p.finditer(t) if fits(m)]
        assert ("[SECRET]" in after[doc]) >= bool(secret) and all(s not in after[doc] for s in secret), doc
        assert secret or after[doc] == t or "[SECRET]" in after[doc]

    packed = collected(pipeline.best_fit_packing(spark, clean, d))
    sizes, from_packing = {}, packing.pieces(clean, llm.tokenizer_file("word_bpe_49k.json"))
    for r in packed:
        sizes.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(packed) == from_packing.count() and all(sum(n for _, n in s) <= 2048 for s in sizes.values())
    for s in sizes.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
