"""Index, ranking, sessions, streams, and the queries against their SQL."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as words
from lodestack.operators import index, search
from lodestack.plans import registry
from lodestack.streaming import sessions

DATA = Path("/root/testdata/sf0.001")


def test_tokens(spark):
    df = spark.createDataFrame([(" <b>The</b> cat's-eye, THE\tend. ñ¿x",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(words.unique_tokens(F.col("t"))).collect()]
    assert got == [["the", "cat", "s", "eye", "end", "ñ¿x"], [], None]


def test_postings(spark):
    lists = spark.createDataFrame([("t", "h1:x:3,h2:abc,,h3,12,h1:9")], "term string, acc string")
    got = {r.doc_id: r.tf for r in index.from_posting_lists(lists).collect()}
    assert got == {"h1": 9, "h2": 1, "h3": 1, "12": 12}


def test_a_whole_index_is_counted_without_a_shuffle(spark, rows, monkeypatch):
    texts = [(k, None if k % 9 == 0 else " ".join(f"w{(k * j) % 7}, W{j % 3}" for j in range(k % 12))) for k in range(60)]
    monkeypatch.setattr(index, "COUNTED", 5)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert rows(index.whole_index(docs)) == rows(index.inverted_index(docs))
    assert "Exchange hashpartitioning" not in index.whole_index(docs)._jdf.queryExecution().executedPlan().toString()
    again = docs.unionByName(docs.where("doc_id < 9")).unionByName(spark.createDataFrame([(None, "w1 x"), (None, "w1")], docs.schema))
    assert rows(index.whole_index(again)) == rows(index.inverted_index(again))


def test_scores(spark):
    rows = [("spark", "d1", 10), ("spark", "d2", 1), *[("common", f"d{k}", 1) for k in range(8)], *[("all", f"d{k}", 1) for k in range(10)]]
    idx = spark.createDataFrame(rows, "term string, doc_id string, tf long")
    n = spark.createDataFrame([(10,)], "n long")
    got = {r.doc_id: round(r.rank_score, 6) for r in search.scores(idx, search.query_terms(spark, "Spark, unknown"), n).collect()}
    assert got == {"d1": 1.39794, "d2": 0.69897}
    assert search.scores(idx, search.query_terms(spark, "common all"), n).collect() == []
    assert search.scores(idx, search.query_terms(spark, ""), n).collect() == []


def test_results(spark):
    docs = spark.createDataFrame([(k, f"u{k}", "" if k % 2 else f"t{k}", None if k % 3 else f"b{k} word{k % 5}") for k in range(400)], "doc_id long, acc string, title string, body string")
    scored = spark.createDataFrame([(k, 1.0 + k // 2) for k in range(350)] + [(9999, 500.0)], "doc_id long, rank_score double")
    ranked = search.top(scored)
    got = search.described(ranked, docs).orderBy(F.desc("rank_score"), "doc_id").collect()
    assert len(got) == 301 and got[0].url is None and [r.doc_id for r in got[1:4]] == [348, 349, 346]
    shown = search.ui_page(search.described(ranked, docs)).collect()
    assert len(shown) == 100 and {r.page for r in shown} == set(range(10))
    by = {r.doc_id: r for r in shown}
    assert by[349].title == "u349" and by[349].body == "Not available for descriptions" and by[348].title == "t348" and by[348].body == "b348 word3"
    answer = json.loads(search.as_json(search.described(ranked, docs)).first().value)
    assert len(answer) == 301 and answer[1] == {"url": "u348", "rank_score": 175.0, "title": "t348", "body": "b348 word3"} and answer[0]["url"] is None


def test_doc_table(spark):
    page = "<html><title> T\n</title><script>var x;</script><body><p>a <b>b</b></p><!-- c --></body></html>"
    assert tuple(index.doc_table(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()) == (1, "u", "T", "a b")


T0 = datetime(2024, 1, 1)


def hits(spark, *seconds, key="u"):
    return spark.createDataFrame([(key, T0 + timedelta(seconds=s)) for s in seconds], "user_id string, ts timestamp")


@pytest.mark.parametrize("form", [sessions.sessions, sessions.session_windows])
def test_sessions(spark, form):
    got = sorted((int((r.start - T0).total_seconds()), int((r.end - T0).total_seconds()), r.n_hits) for r in form(hits(spark, 0, 300, 600, 901, 901)).collect())
    assert got == [(0, 600, 3), (901, 901, 2)]


def test_liveness(spark):
    pings = hits(spark, 0, 10).unionByName(hits(spark, 0, key="v"))
    got = {r.user_id: r.active for r in sessions.liveness(pings, "2024-01-01 00:00:25").collect()}
    assert got == {"u": True, "v": False}


def test_session_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    hits(spark, 0, 100, 900).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("user_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    hits(spark, 20_000).coalesce(1).write.mode("append").parquet(source)
    hits(spark, 50).coalesce(1).write.mode("append").parquet(source)  # far too late once the watermark has passed
    query = sessions.session_windows(stream, late="10 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", sink).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted((r.start - T0).total_seconds() for r in spark.read.parquet(sink).collect())
    assert got == [0.0, 900.0]


def test_throttle_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("a", T0 + timedelta(milliseconds=m)) for m in (0, 400, 1000, 1999, 2000)] + [("b", T0)]
    spark.createDataFrame(rows, "host string, ts timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("host string, ts timestamp").parquet(source)
    query = sessions.throttled(stream, forget_ms=None).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted((r.host, int((r.ts - T0).total_seconds() * 1000), r.allowed) for r in spark.table("throttled").collect())
    assert got == [("a", 0, True), ("a", 400, False), ("a", 1000, True), ("a", 1999, False), ("a", 2000, True), ("b", 0, True)]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def shaped(df):
    return sorted(tuple("null" if x is None or x is pd.NA or x is pd.NaT or x != x else str(int(x) if isinstance(x, float) and x == int(x) else x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    assert shaped(registry.QUERIES[name](spark, str(DATA)).toPandas()) == shaped(sql.sql(registry.SQL[name]).df())
