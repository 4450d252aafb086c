"""The registered queries against their SQL, on the smallest data."""

import datetime
import decimal

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["term_freq", "idf", "bm25_search", "version_chains", "resolve_as_of", "hybrid_retrieve", "auto_citations", "citation_guard", "article_documents", "crawl_quarantine", "convenience_edges", "bitemporal_items", "watch_dates", "sync_report", "stream_sync", "mask_pii", "law_citations"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 5) + 0.0
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    out = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    assert sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=str) == got


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "position", "entity_id", "type", "score", "reason"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
