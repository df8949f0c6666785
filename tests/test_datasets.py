"""Bags, pairs and key-value tables on small fixtures."""

import json
import random
from functools import reduce
from types import SimpleNamespace

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack import command
from lodestack.functions import dates
from lodestack.operators import bags, kv, pairs
from lodestack.sources import staging


def bag(spark, *items):
    return bags.parallelize(spark, items)


def pair(spark, *items):
    return spark.createDataFrame(list(items), "key string, value string")


def values(df):
    return sorted(r[0] for r in df.collect())


def test_bag_operators(spark, rows):
    b = bag(spark, "a", "b", "a")
    assert values(b) == ["a", "a", "b"] and values(bags.distinct(b)) == ["a", "b"]
    assert values(bags.intersection(bag(spark, "a", "a", "b"), bag(spark, "a", "c"))) == ["a"]
    assert rows(bags.group_by(bag(spark, "apple", "bean", "avocado"), F.substring("value", 1, 1))) == [("a", "apple,avocado"), ("b", "bean")]
    assert rows(bags.fold_sum(bag(spark, "1", "2", "3"))) == [(6,)] and rows(bags.fold_sum(bag(spark, "1", "2", "3").repartition(3), 10)) == [(16,)]
    assert rows(bags.fold_sum(bag(spark), 4)) == [(4,)]
    assert rows(bags.fold_ordered(bag(spark, "b", "a"), "", lambda acc, x: F.concat(acc, x))) == [("ab",)]
    assert rows(bags.count(bag(spark))) == [(0,)] and len(bags.take(b, 2).collect()) == 2
    assert values(bags.keep(b, F.col("value") == "a")) == ["a", "a"]
    assert bags.output([]) == "No Output." and bags.output(["x", "y"]) == "xy"


def test_one_to_many(spark, rows):
    some = spark.createDataFrame([("x x y",), ("",), (None,)], "value string")
    words = F.filter(F.split("value", " "), lambda w: w != "")
    assert values(bags.flat_map(some, words)) == ["x", "x", "y"]
    made = bags.flat_map_to_pair(some, F.transform(words, lambda w: F.struct(w.alias("key"), F.lit(1).alias("value"))))
    assert rows(made) == [("x", 1), ("x", 1), ("y", 1)]
    assert rows(bags.map_to_pair(some, F.col("value"), F.length("value"))) == [("", 0), ("x x y", 5)]
    assert values(bags.from_table(some, F.nullif("value", F.lit("")))) == ["x x y"]


def test_partitions(spark):
    def count(batches):
        yield pd.DataFrame({"value": [str(sum(len(b) for b in batches))]})

    out = values(bags.map_partitions(bag(spark, "a", "b", "c").repartition(2), count))
    assert sum(map(int, out)) == 3


def test_samples(spark):
    many = spark.range(1000).select(F.col("id").cast("string").alias("value")).repartition(7)
    assert bags.sample_exact(many, 0.1234).count() == 124 and bags.sample_exact(many, 0.1234).distinct().count() == 124
    assert bags.sample_exact(many, 1.5, replace=True).count() == 1500
    assert bags.sample_exact(bag(spark), 0.5).count() == 0
    assert 0 < bags.sample(many, 0.5, 1).count() < 1000
    hashed = bags.sample_hashed(many, F.col("value"), 0.3)
    assert values(hashed) == values(bags.sample_hashed(many.repartition(2), F.col("value"), 0.3)) and 200 < hashed.count() < 400


def test_pair_operators(spark, rows):
    a, b = pair(spark, ("a", "1"), ("a", "2"), ("b", "3")), pair(spark, ("a", "9"), ("c", "8"))
    assert rows(pairs.join(a, b)) == [("a", "1,9"), ("a", "2,9")]
    assert rows(pairs.cogroup(a, b)) == [("a", "[1,2],[9]"), ("b", "[3],[]"), ("c", "[],[8]")]
    assert rows(pairs.fold_by_key(a.withColumn("value", F.col("value").cast("int")))) == [("a", 3), ("b", 3)]
    assert rows(pairs.fold_by_key_ordered(a, F.lit("0"), lambda x, y: F.concat(x, y))) == [("a", "012"), ("b", "03")]
    assert values(pairs.flat_map(a, F.array("key", "value"))) == ["1", "2", "3", "a", "a", "b"]
    assert rows(pairs.flat_map_to_pair(b, F.array(F.struct(F.col("value").alias("key"), F.col("key").alias("value"))))) == [("8", "c"), ("9", "a")]
    assert [tuple(r) for r in pairs.ordered(a).collect()] == [("a", "1"), ("a", "2"), ("b", "3")]


def test_pairs_of_one_key_are_made_by_many_tasks(spark):
    a = spark.range(0, 20_000, 1, 1).select(F.lit("hot").alias("key"), (F.col("id") % 10_000).cast("string").alias("value")).unionByName(pair(spark, ("b", "1"), ("c", "1"))).coalesce(1)
    b = spark.range(0, 60, 1, 1).select(F.lit("hot").alias("key"), (F.col("id") % 50).cast("string").alias("value")).unionByName(pair(spark, ("b", "2"), ("d", "2")))
    got = pairs.join(a, b)
    held = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("value")).collect()]
    assert max(held) < 0.6 * sum(held) and sum(held) == 20_000 * 60 + 1
    of = got.groupBy("key", "value").count().groupBy("key", "count").count().collect()
    assert sorted(map(tuple, of)) == [("b", 1, 1), ("hot", 2, 10_000 * 40), ("hot", 4, 10_000 * 10)]


def test_copies_for_a_join_grow_with_the_rows(spark, monkeypatch):
    dealt, deal = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, *by: dealt.append(self) or deal(self, *by))
    held = []
    for n in (30_000, 120_000):
        many, few = (spark.range(0, k, 1, 2).select(F.lit("hot").alias("key"), F.col("id").cast("string").alias("value")) for k in (n, n // 4))
        pairs.join(many, few)
        held.append(sum(df.count() for df in dealt))
        dealt.clear()
    assert held[0] <= 4 * 37_500 and held[1] <= 1.2 * 4 * held[0]  # 16 pairs of slices: 8 by 2


def test_slices_meet_once_each(spark):
    kinds = {"even": (9000, 9000), "left": (9000, 10), "right": (10, 9000), "other": (3, 4)}
    side = lambda at: reduce(DataFrame.unionByName, [spark.range(n[at]).select(F.lit(k).alias("key"), F.col("id").cast("string").alias("value")) for k, n in kinds.items()])
    got = pairs.join(side(0), side(1)).groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("h"))
    whole = side(0).join(side(1).withColumnRenamed("value", "other"), "key").groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.concat_ws(",", "value", "other")).cast("decimal(38,0)")).alias("h"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and {r.key: r.n for r in got.collect()} == {k: a * b for k, (a, b) in kinds.items()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-50, 50)), max_size=20), st.lists(st.tuples(st.sampled_from("bcd"), st.integers(-50, 50)), max_size=20))
def test_pair_laws(spark, left, right):
    a, b = (spark.createDataFrame(x, "key string, value int") for x in (left, right))
    groups = {r.key: r.value for r in pairs.cogroup(a, b).collect()}
    assert set(groups) == {k for k, _ in left + right}
    joined = sum(sum(1 for k, _ in left if k == key) * sum(1 for k, _ in right if k == key) for key in groups)
    assert pairs.join(a, b).count() == joined
    folded = {r.key: r.result for r in pairs.fold_by_key(a).collect()}
    assert folded == {k: sum(v for x, v in left if x == k) for k, _ in left}


def test_scan_and_points(spark, rows):
    t = kv.rows_of(spark.createDataFrame([("a", "1", None), ("b", "2", "x"), ("c", "3", "y")], "k string, p string, q string"), F.col("k"), "p", "q")
    keys = lambda df: [r.row_key for r in df.orderBy("row_key").collect()]
    assert keys(kv.scan(t, "a", "c")) == ["a", "b"] and keys(kv.scan(t)) == ["a", "b", "c"] and keys(kv.scan(t, "b")) == ["b", "c"]
    assert rows(kv.get_cell(t, "b", "q")) == [("x",)] and rows(kv.get_cell(t, "a", "q")) == [(None,)] and rows(kv.get_row(t, "z")) == []
    assert kv.get_row(t, "a").first().cols == {"p": "1"}
    assert rows(kv.exists(t, spark.createDataFrame([("a",), ("z",)], "row_key string"))) == [("a", True), ("z", False)]
    assert rows(kv.table_list({"t": (t, F.col("row_key"))})) == [("t", 3)]


def test_log_equals_replay(spark):
    rng = random.Random(1)
    log = [(n, rng.choice(["cell", "cell", "row"]), rng.choice("ab"), {rng.choice("xyz"): str(n)}) for n in range(60)]

    def apply(state, entry):
        _, op, key, cols = entry
        return state | {key: cols if op == "row" else state.get(key, {}) | cols}

    want = reduce(apply, log, {})
    got = kv.current(spark.createDataFrame(log, "seq long, op string, row_key string, cols map<string,string>").repartition(3))
    assert {r.row_key: r.cols for r in got.collect()} == want


def test_storage(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    kv.save_as(bag(spark, "a"), old)
    assert not kv.rename(spark, old, old) and kv.rename(spark, old, new) and values(spark.read.parquet(new)) == ["a"]
    kv.save_as(bag(spark, "b"), old)
    assert not kv.rename(spark, old, new)
    try:
        kv.save_as(bag(spark, "c"), old)
    except Exception as e:
        assert "EXISTS" in str(e).upper()
    else:
        raise AssertionError
    kv.append(bag(spark, "d"), old)
    assert values(spark.read.parquet(old)) == ["b", "d"]


def test_pages_of_rows(spark):
    t = spark.range(25).select(F.format_string("%02d", "id").alias("row_key"))
    look = lambda n: [(r.row_key, r.has_next) for r in kv.page(t, n).collect()]
    assert look(0)[0] == ("00", True) and len(look(0)) == 10
    assert look(20) == [(f"{k}", False) for k in range(20, 25)] and look(15)[-1] == ("24", False)
    assert look(99) == look(0)


def test_latest(spark, rows):
    log = spark.createDataFrame([(1, "a", "x", "1"), (3, "a", "x", "3"), (2, "a", "x", "2"), (1, "b", "y", "0")], "seq int, row_key string, col string, value string")
    assert rows(kv.latest_cells(log)) == [("a", "x", "3"), ("b", "y", "0")]
    assert rows(kv.latest_rows(log).select("row_key", "seq")) == [("a", 3), ("b", 1)]


def test_exact_samples_are_spread_and_whole(spark):
    many = spark.range(100_000).select(F.col("id").cast("string").alias("value"))
    for fraction in (0.00001, 0.5, 0.99999, 1.0):
        got = bags.sample_exact(many, fraction, seed=3)
        assert got.count() == got.distinct().count() == -(-int(100_000 * fraction * 10**9) // 10**9)
    assert values(bags.sample_exact(many, 0.001, 5)) == values(bags.sample_exact(many, 0.001, 5))


def test_command_line(spark, tmp_path):
    said = []
    do = lambda *words: command.run(spark, str(tmp_path), list(words), said.append)
    assert do("put", "t", "k1", "a", "1") and do("put", "t", "k2", "a", "2") and do("put", "t", "k1", "b", "x y") and do("put", "t", "k1", "a", "3")
    assert do("get", "t", "k1", "a") and said.pop() == "3"
    assert do("get", "t", "k1") and json.loads(said.pop()) == {"row_key": "k1", "cols": {"a": "3", "b": "x y"}}
    assert not do("get", "t", "nobody") and not do("get", "t", "k1", "nothing") and not said
    assert do("scan", "t", "k2") and [json.loads(x)["row_key"] for x in said] == ["k2"]
    assert do("rename", "t", "u") and not do("rename", "u", "u") and do("get", "u", "k2", "a")
    assert not do("put", "t") and "get TABLE" in said[-1]


def test_scans_by_path(spark):
    table = spark.createDataFrame([("a b",), ("c",), ("d",)], "row_key string")
    scan = lambda path: [r.row_key for r in kv.scan_path({"t": table}, path).orderBy("row_key").collect()]
    assert scan("/data/t/a%20b/d") == ["a b", "c"] and scan("/data/t") == ["a b", "c", "d"] and scan("/data/t/c") == ["c", "d"] and scan("/data/none/a/b") == []


def test_no_folder_of_its_own_on_a_cluster():
    session = lambda master, **conf: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="checkpoint"):
        staging.folder(session("spark://host:7077"))
    assert staging.folder(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs:/shared/"})) == "hdfs:/shared"
    assert staging.folder(session("local[4]"))


def test_http_dates(spark):
    texts = [("Sun, 06 Nov 1994 08:49:37 GMT",), ("Sun, 06 Foo 1994 08:49:37 GMT",), ("",), (None,)]
    got = spark.createDataFrame(texts, "t string").select(F.unix_seconds(dates.from_http_date(F.col("t"))).alias("s"), dates.http_date(dates.from_http_date(F.col("t"))).alias("t")).collect()
    assert [r.s for r in got] == [784111777, None, None, None] and got[0].t == texts[0][0]
