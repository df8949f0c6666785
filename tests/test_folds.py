"""Tree folds, ranked pages, sketches, table functions and a live fetch of many hosts."""

import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lodestack.functions import tables
from lodestack.operators import folds, kv, sketches
from lodestack.sources import web


def streak(values):
    return len(values), max((len(list(g)) for _, g in groupby(values)), default=0)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_a_fold_in_order_equals_a_walk(spark, rows, fan_in, monkeypatch):
    monkeypatch.setattr(folds, "FAN_IN", fan_in)
    rng = random.Random(fan_in)
    data = [(rng.choice(["a", "a", "a", "b", None]), k, rng.choice(["x", "x", "x", "y", None])) for k in range(400)]
    df = spark.createDataFrame(data, "k string, at long, v string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        fold = folds.Streak("v")
        assert rows(fold.of(df, ["at"])) == [streak([v for _, _, v in data])]
        assert rows(fold.of(df, ["at"], ["k"])) == sorted(((k, *streak([v for x, _, v in data if x == k])) for k in ("a", "b", None)), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_hot_key_is_folded_by_many_tasks_and_text_in_order(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = spark.sparkContext.accumulator(0)
    try:
        df = spark.range(5000).select(F.lit("hot").alias("k"), "id")
        got = folds.fold_tree(df, str, lambda acc, b: seen.add(1) or acc + "".join(f"{i};" for i in b["id"]), lambda a, b: a + b, lambda a: (a,), "text string", ["k"], ["id"], fan_in=2)
        assert got.first().text == "".join(f"{i};" for i in range(5000))
        assert seen.value >= 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_folds_of_nothing_and_without_order(spark, rows):
    none = spark.createDataFrame([], "k string, n long")
    total = lambda df, by=(): folds.fold_tree(df, int, lambda acc, b: acc + int(b["n"].sum()), lambda a, b: a + b, lambda a: (a,), "total long", by)
    assert rows(total(none)) == [(0,)]
    assert rows(total(none, ["k"])) == []
    some = spark.range(100).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("n")).repartition(7)
    assert rows(total(some)) == [(4950,)]
    assert rows(total(some, ["k"])) == [("0", 1683), ("1", 1617), ("2", 1650)]


def test_pages_from_stored_ranges(spark, tmp_path):
    table = spark.range(30_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("row_key"), F.col("id").alias("v")).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kv.save_ranked(table, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for offset, size in ((0, 10), (7_495, 10), (14_000, 3000), (29_995, 10), (29_999, 1), (30_000, 10), (30_001, 10)):
        start = 0 if offset > 30_000 else offset
        page = kv.page_ranked(spark, str(tmp_path / "t"), offset, size)
        got = page.collect()
        assert [r.v for r in got] == list(range(start, min(30_000, start + size))), offset
        assert all(r.has_next == (30_000 - start > size) for r in got)
    plan = kv.page_ranked(spark, str(tmp_path / "t"), 20_000, 10)._jdf.queryExecution().executedPlan().toString()
    assert "(_range#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(_place" in plan
    assert [r.v for r in kv.page(table, 20_000).collect()] == list(range(20_000, 20_010))
    kv.save_ranked(table.limit(0), str(tmp_path / "none"))
    assert kv.page_ranked(spark, str(tmp_path / "none"), 5).count() == 0


def test_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 30).alias("day"), (F.col("id") % 9000).alias("item"), (F.col("id") / 2).alias("v"))
    parts = sketches.sketched(df, ["g", "day"], F.col("item"), F.col("v"))
    both = {r.g: r for r in sketches.estimates(sketches.merged(parts, ["g"])).collect()}
    for r in both.values():
        assert r.n == 30_000 and abs(r.n_items - 4500) < 4500 * 0.07
        assert all(abs(q / 30_000 - want) < 0.02 for q, want in zip(r.quantiles, (0.5, 0.9, 0.99), strict=True))
    whole = sketches.estimates(sketches.merged(parts)).first()
    assert whole.n == 60_000 and abs(whole.n_items - 9000) < 9000 * 0.07
    halves = [sketches.merged(parts.where(f"day {op} 15"), ["g"]) for op in ("<", ">=")]
    assert all(r.n_shared <= 100 for r in sketches.shared_items(*halves, "g").collect())
    nulls = spark.createDataFrame([(1, None, None), (1, 5, 2.0), (2, None, None)], "g int, item long, v double")
    got = {r.g: (r.n, r.n_items, r.quantiles) for r in sketches.estimates(sketches.merged(sketches.sketched(nulls, ["g"], F.col("item"), F.col("v")), ["g"]), [0.5]).collect()}
    assert got == {1: (2, 1, [2.0]), 2: (1, 0, None)}


def test_pieces_of_any_table(spark):
    tables.register(spark)
    df = spark.createDataFrame([("a", 2, "x,,y"), ("a", 1, "z"), ("b", 1, None), ("c", 1, "")], "k string, at int, t string")
    got = spark.sql("SELECT * FROM pieces(TABLE({df}) PARTITION BY k ORDER BY (at), 't', ',')", df=df)
    assert got.columns == ["k", "at", "n", "pos", "piece"]
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1, 1, "z"), ("a", 2, 2, 1, "x"), ("a", 2, 3, 2, "y")]
    with pytest.raises(Exception, match="no text column"):
        spark.sql("SELECT * FROM pieces(TABLE({df}), 'at', ',')", df=df).collect()


def test_many_hosts_are_asked_at_once_and_each_in_turn(spark):
    now, most, times, lock = {}, [0], {}, threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            host = self.headers["Host"]
            with lock:
                now[host] = now.get(host, 0) + 1
                assert now[host] == 1
                most[0] = max(most[0], sum(now.values()))
                times.setdefault(host, []).append((self.command, time.monotonic()))
            time.sleep(0.1)
            with lock:
                now[host] -= 1
            self.send_response(200)
            self.end_headers()

        do_HEAD = do_GET

        def log_message(self, *args):
            pass

    servers = [ThreadingHTTPServer(("127.0.0.1", 0), Handler) for _ in range(6)]
    for s in servers:
        threading.Thread(target=s.serve_forever, daemon=True).start()
    frontier = spark.createDataFrame([(f"http://127.0.0.1:{s.server_port}/{k}",) for s in servers for k in range(3)], "url string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = web.fetch(frontier, "test", workers=4, pause=0.3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for s in servers:
            s.shutdown()
    assert len(got) == 18 and {r.status for r in got} == {200}
    assert 2 <= most[0] <= 4
    for asked in times.values():
        heads = [t for c, t in asked if c == "HEAD"]
        assert len(heads) == 3 and min(b - a for a, b in zip(heads, heads[1:], strict=False)) >= 0.3
