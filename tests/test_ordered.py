"""Joins by order and stitched sessions: against brute force, and with one key that has nearly all rows."""

import datetime
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from lodestack.functions import urls
from lodestack.operators import crawl, kv, ranges, robots
from lodestack.streaming import sessions

SKEWED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
}


@contextmanager
def settings(spark, **more):
    wanted = SKEWED | more
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def most_in_a_task(df):
    """The largest task's share of the rows; all columns are read."""
    held = [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.xxhash64(*df.columns))).collect()]
    return max(held) / sum(held)


# ---- range join


@pytest.mark.parametrize("many", [1, 30])
def test_range_join_equals_brute_force(spark, rows, many):
    rng = random.Random(many)
    pick = lambda n: None if rng.random() < 0.05 else rng.randrange(n)
    points = [(rng.choice(["a", "b", "c", None]), pick(60), k % 50) for k in range(300)]
    spans = [(rng.choice(["a", "b", "d", None]), pick(60), pick(60), k % 20) for k in range(4 * many)] + [("a", 5, 5, 90), ("a", None, None, 91), ("b", 0, None, 92), ("b", 0, None, 92), ("c", 30, 60, 93)]
    p = spark.createDataFrame(points, "k string, v long, id long").repartition(3)
    r = spark.createDataFrame(spans, "k string, low long, high long, what long").repartition(2)
    want = [(*x, lo, hi, w) for x in points for k, lo, hi, w in spans if k is not None and k == x[0] and None not in (lo, x[1]) and lo <= x[1] and (hi is None or x[1] < hi)]
    assert rows(ranges.range_join(p, r, "k", "v", "low", "high")) == sorted(want, key=repr)


def test_range_join_of_nothing(spark):
    p = spark.createDataFrame([], "k string, v long")
    r = spark.createDataFrame([], "k string, low long, high long, what long")
    assert ranges.range_join(p, r, "k", "v", "low", "high").count() == 0


def test_ranges_of_one_key_are_searched_by_many_tasks(spark):
    p = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("v"))
    r = spark.range(400).select(F.lit("hot").alias("k"), (F.col("id") * 100).alias("low"), (F.col("id") * 100 + 150).alias("high"), F.col("id").alias("what"))
    with settings(spark):
        got = ranges.range_join(p, r, "k", "v", "low", "high")
        assert got.count() == 40_000 + 399 * 50 and got.where("v < low or v >= high").count() == 0
        assert most_in_a_task(got) < 0.6


def test_prefix_ranges(spark):
    texts = ["/a", "/ab", "/aÿ", "/b", "/", "/a\U0010ffff", "/a\U0010ffffz"]
    low, high = ranges.prefix_range(F.lit("/a"))
    got = spark.createDataFrame([(t,) for t in texts], "t string").where((F.col("t").cast("binary") >= low) & (F.col("t").cast("binary") < high))
    assert sorted(r.t for r in got.collect()) == sorted(t for t in texts if t.startswith("/a"))


# ---- as-of join


def held(left, right, forward, strict, within):
    out = []
    for k, t, i in left:
        ok = [r for r in right if None not in (r[0], r[1], k, t) and r[0] == k and ((r[1] > t or (r[1] == t and not strict)) if forward else (r[1] < t or (r[1] == t and not strict)))]
        best = (min if forward else max)((r[1] for r in ok), default=None)
        tied = [r for r in ok if r[1] == best]
        found = max(tied, key=lambda r: r[2]) if tied and (within is None or abs(best - t) <= within) else (None,) * 4
        out.append((k, t, i, *found[1:]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("within", [None, 5])
def test_as_of_join_equals_brute_force(spark, rows, forward, strict, within):
    rng = random.Random(7)
    pick = lambda n: None if rng.random() < 0.05 else rng.randrange(n)
    left = [(rng.choice(["a", "a", "b", "c", None]), pick(80), k % 60) for k in range(150)]
    right = [(rng.choice(["a", "a", "b", "d", None]), pick(80), k, f"x{k}") for k in range(60)]
    a, b = spark.createDataFrame(left, "k string, t long, i long").repartition(3), spark.createDataFrame(right, "k string, t long, n long, what string").repartition(2)
    got = ranges.as_of_join(a, b, ["k"], "t", tie=["n"], forward=forward, strict=strict, within=None if within is None else F.lit(within))
    assert got.columns == ["k", "t", "i", "t_right", "n", "what"]
    assert rows(got) == held(left, right, forward, strict, within)


def test_as_of_join_without_rows(spark):
    a, b = spark.createDataFrame([("a", 1)], "k string, t long"), spark.createDataFrame([], "k string, t long, w long")
    assert [tuple(r) for r in ranges.as_of_join(a, b, ["k"], "t").collect()] == [("a", 1, None, None)]
    assert ranges.as_of_join(a.limit(0), b, ["k"], "t").count() == 0


def test_times_of_one_key_are_looked_up_by_many_tasks(spark):
    a = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    b = spark.range(5).select(F.lit(1).alias("k"), (F.col("id") * 9_000).alias("t"), F.col("id").alias("w"))
    with settings(spark):
        got = ranges.as_of_join(a, b, ["k"], "t")
        assert got.where("w <> least(4, floor(t / 9000)) or w is null").count() == 0 and got.count() == 40_000
        assert most_in_a_task(got) < 0.6


def test_rows_as_of(spark, rows):
    log = [(1, "cell", "r", {"a": "1"}), (2, "cell", "r", {"b": "2"}), (3, "row", "r", {"a": "3"}), (4, "cell", "q", {"a": "4"}), (5, "row", "r", {}), (6, "cell", "r", {"c": "6"}), (7, "cell", None, {"c": "7"})]
    df = spark.createDataFrame(log, kv.LOG)
    reads = spark.createDataFrame([("r", k) for k in range(8)] + [("r", 2), ("q", 3), ("q", 9), ("none", 5), (None, 7), ("r", None)], "row_key string, at long")
    got = {(r.row_key, r.at): r.cols for r in kv.rows_as_of(df, reads).collect()}
    assert got == {("r", 1): {"a": "1"}, ("r", 2): {"a": "1", "b": "2"}, ("r", 3): {"a": "3"}, ("r", 4): {"a": "3"}, ("r", 6): {"c": "6"}, ("r", 7): {"c": "6"}, ("q", 9): {"a": "4"}}
    now = {r.row_key: r.cols for r in kv.current(df.where("row_key is not null")).collect()}
    assert now == {"r": {"c": "6"}, "q": {"a": "4"}}


def test_times_asked_for_are_made_distinct_by_many_tasks(spark, monkeypatch):
    """Small rows that compress well: adaptive execution would give all of them to one task."""
    made, spread = [], ranges.spread_distinct
    monkeypatch.setattr(ranges, "spread_distinct", lambda df: made.append(spread(df)) or made[-1])
    a = spark.range(0, 80_000, 1, 2).select((F.col("id") % 2).alias("k"), (F.col("id") % 40_000).alias("t"))
    got = ranges.as_of_join(a, a.limit(0).withColumn("w", F.lit(1)), ["k"], "t")
    assert got.count() == 80_000 and got.where("w is not null").count() == 0
    assert [df.count() for df in made] == [40_000] and most_in_a_task(made[0]) < 0.6 < most_in_a_task(a.distinct())


# ---- sessions


@pytest.mark.parametrize("keys", [1, 4])
def test_stitched_sessions_equal_a_walk(spark, rows, keys):
    rng = random.Random(keys)
    zero = datetime.datetime(2024, 1, 1)
    hits = [(rng.choice([*range(keys), None]), zero + datetime.timedelta(seconds=rng.choice([1, 299, 300, 301]) * rng.randrange(200))) for _ in range(250)] + [(0, None), (None, None)]
    want = []
    for k in {h[0] for h in hits}:
        times = sorted(t for x, t in hits if x == k and t is not None)
        runs = [[times[0]]]
        for t in times[1:]:
            runs[-1].append(t) if (t - runs[-1][-1]).total_seconds() <= 300 else runs.append([t])
        want += [(k, r[0], r[-1], len(r)) for r in runs]
    df = spark.createDataFrame([(*h, "clash") for h in hits], "user_id long, ts timestamp_ntz, part string").repartition(3)
    with settings(spark, **{"spark.sql.shuffle.partitions": "13"}):
        assert rows(sessions.sessions(df)) == sorted(want, key=repr)
    assert rows(sessions.session_windows(df.withColumn("ts", F.col("ts").cast("timestamp")))) == sorted(want, key=repr)


def test_sessions_of_one_key_are_found_by_many_tasks(spark):
    """Nine tenths of the hits are one user's, and most of those are one session over all borders."""
    at = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + n)
    hot = spark.range(36_000).select(F.lit(1).cast("long").alias("user_id"), at(F.when(F.col("id") < 30_000, F.col("id")).otherwise(F.col("id") * 1000)).alias("ts"))
    hits = hot.unionByName(spark.range(4_000).select((F.col("id") + 2).alias("user_id"), at(F.col("id")).alias("ts")))
    with settings(spark):
        got = sessions.sessions(hits)
        assert {r.n_hits: r["count"] for r in got.groupBy("n_hits").count().collect()} == {30_000: 1, 1: 10_000}
        assert most_in_a_task(got) < 0.6


# ---- joins on hot keys


def test_a_host_with_most_pages_is_decided_by_many_tasks(spark):
    pages = spark.range(40_000).select(F.concat(F.when(F.col("id") < 36_000, F.lit("http://one.example:80")).otherwise(F.concat(F.lit("http://h"), "id", F.lit(".example:80"))), F.lit("/p"), "id").alias("url"))
    rules = robots.parse(spark.createDataFrame([("http://one.example:80", "User-agent: *\nAllow: /p12\nDisallow: /p1\nDisallow: /p2\n")], "host string, body string"))
    with settings(spark):
        got = robots.decide(pages, rules, "bot")
        want = F.col("url").startswith("http://one.") & F.col("url").rlike("/p(1(?!2)|2)")
        assert got.where(F.col("allowed") == want).count() == 0 and got.count() == 40_000
        assert most_in_a_task(got) < 0.6


def test_rules_equal_a_walk_through_them(spark, rows):
    rng = random.Random(2)
    letters = "ab/é"
    path = lambda n: "/" + "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    lines = {h: [(rng.choice(["*", "bot", "other"]), rng.choice(["allow", "disallow"]), path(4)) for _ in range(12)] for h in ("http://a:80", "http://b:80")}
    body = {h: "\n".join(f"User-agent: {a}\n{f}: {p}" for a, f, p in ls) for h, ls in lines.items()}
    urls_ = [h + path(7) for h in ("http://a:80", "http://b:80", "http://c:80") for _ in range(60)]
    got = robots.decide(spark.createDataFrame([(u, 1) for u in urls_], "url string, key int"), robots.parse(spark.createDataFrame(list(body.items()), "host string, body string")), "Bot")

    def allowed(u):
        h, p = u[:11], u[11:]
        ordered = [x for agent in ("bot", "*") for x in lines.get(h, []) if x[0] == agent]
        return next((f == "allow" for _, f, prefix in ordered if p.startswith(prefix)), True)

    assert rows(got) == sorted(((u, 1, allowed(u)) for u in urls_), key=repr)


def test_a_content_of_most_pages_is_not_gathered(spark):
    pages = spark.range(40_000).select(F.col("id").cast("string").alias("url"), F.when(F.col("id") % 10 > 0, F.repeat(F.lit("same "), 20)).otherwise(F.concat(F.lit("own "), "id")).alias("page"), F.lit(0).alias("round"), F.md5(F.col("id").cast("string")).alias("more"))
    with settings(spark):
        got = crawl.deduplicated(pages)
        assert got.where("canonical_url is not null").count() == 35_999
        assert most_in_a_task(got) < 0.6


def test_a_row_with_most_of_the_log_is_not_gathered(spark):
    log = spark.range(40_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 1000 == 0, "row").otherwise("cell").alias("op"), F.lit("hot").alias("row_key"), F.create_map(F.concat(F.lit("c"), F.col("id") % 7), F.col("id").cast("string")).alias("cols"))
    plan = kv.current(log)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert kv.current(log).first().cols == {f"c{k % 7}": str(k) for k in range(39_993, 40_000)}


def test_paths_of_hosts(spark):
    got = spark.createDataFrame([("http://a:80/x",)], "u string").select(urls.path_of(F.col("u")).alias("p")).first().p
    assert got == "/x"
