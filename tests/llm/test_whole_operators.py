"""Operators 1 and 10 do their whole job: large blocked hosts, and every language."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
llm = pytest.importorskip("statuta.llm.queries")
from statuta.llm import langid, url_filter  # noqa: E402


def collected(df):
    return df.collect()


def test_linkers_of_a_large_blocked_host(spark):
    link = '<a href="http://{}/x">y</a>'
    rows = [(0, "http://bad.com/de/1", None), (1, "http://good.com/fr/1", link.format("friend.net")), (2, "http://friend.net/", link.format("good.com")), (3, "http://alone.net/", None)]
    rows += [(10 + k, f"http://farm{k}.net/", link.format("bad.com")) for k in range(60)] + [(100, "http://second.net/", link.format("farm0.net"))]
    found = {r["page_id"]: r for r in collected(url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), llm.URL_RULES))}
    assert {found[10 + k]["verdict"] for k in range(60)} == {"block"} and found[100]["verdict"] == "block"
    assert [found[k]["verdict"] for k in (1, 2, 3)] == ["allow"] * 3 and found[3]["distrust"] == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "WORDS_PER_LANGUAGE", 60, raising=False)
    letters = [chr(0x4E00 + 97 * k) for k in range(70)]
    rows = [(2 * k + n, (c + "a") * 3 + " " + c * 4, f"l{k:02d}") for k, c in enumerate(letters) for n in range(2)] + [(999, "xyz", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert langid._Scorer(model).languages == [f"l{k:02d}" for k in range(70)]
    few = spark.createDataFrame([(k, f"{'abc' if k % 2 else 'xyz'} " * 40, "ab" if k % 2 else "xy") for k in range(40)], "doc_id long, text string, lang string")
    found = collected(langid.predict(few, langid.fit(few, F.lit(True))))
    assert all(r["lang_pred"] == ("ab" if r["doc_id"] % 2 else "xy") for r in found)
