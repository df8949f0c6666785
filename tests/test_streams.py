"""Streams that defer, join and tell what is late."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.plans import ordered
from lodestack.streaming import deferral, joins

T0 = datetime(2024, 1, 1)
ATTEMPT = "host string, url string, ts timestamp"


def at(ms):
    return T0 + timedelta(milliseconds=ms)


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k, None) for k in deferral.STORE}
    for k, v in deferral.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    return spark.table(name).collect()


def source(spark, path, files, schema):
    """A stream of one batch for each file."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def grants(attempts, pause):
    last, out = {}, []
    for host, url, t in sorted((a for a in attempts if a[0] is not None and a[2] is not None), key=lambda a: (a[2], a[1])):
        last[host] = max(t, last[host] + timedelta(milliseconds=pause)) if host in last else t
        out.append((host, url, t, last[host]))
    return sorted(out)


def test_slots():
    assert deferral.slots(np.array([0, 400, 1000, 1999, 9000]), 1000).tolist() == [0, 1000, 2000, 3000, 9000]
    assert deferral.slots(np.array([5, 6]), 10, last=0).tolist() == [10, 20]
    assert deferral.slots(np.array([], np.int64), 10, last=3).tolist() == []


def test_stored_attempts_are_deferred(spark, rows):
    rng = random.Random(1)
    attempts = [(rng.choice(["a", "b", None]), f"u{k}", None if k % 17 == 0 else at(rng.randrange(20_000))) for k in range(80)]
    assert rows(deferral.deferred(spark.createDataFrame(attempts, ATTEMPT).repartition(3), 700)) == sorted(grants(attempts, 700), key=repr)


def test_deferred_urls_come_out_by_timers_and_in_order(spark, store, tmp_path):
    rng = random.Random(2)
    first = [(rng.choice("abc"), f"u{k:03}", at(rng.randrange(10_000))) for k in range(60)] + [(None, "no host", at(0)), ("a", "no time", None)]
    second = [(rng.choice("abc"), f"v{k:03}", at(rng.randrange(9_000, 20_000))) for k in range(40)]  # some are older than the first batch's newest
    end = [("end", "end", at(10_000_000))]
    got = run(spark, deferral.deferred_stream(source(spark, str(tmp_path / "in"), [first, second, end], ATTEMPT), 700, late="5 seconds"), "deferred")
    assert sorted(map(tuple, got)) == grants(first + second, 700)
    for host in "abc":  # each host's URLs come out by slot
        mine = [r.granted for r in got if r.host == host]
        assert mine == sorted(mine) and min((b - a).total_seconds() for a, b in zip(mine, mine[1:], strict=False)) >= 0.7


def test_a_deferred_url_leaves_without_news_of_its_host(spark, store, tmp_path):
    files = [[("a", "1", at(0)), ("a", "2", at(1))], [("b", "x", at(100_000))], [("b", "y", at(200_000))]]
    got = run(spark, deferral.deferred_stream(source(spark, str(tmp_path / "in"), files, ATTEMPT), 30_000, late="1 second"), "deferred_alone")
    assert sorted(tuple(r)[1::2] for r in got if r.host == "a") == [("1", at(0)), ("2", at(30_000))]


def test_slots_of_many_hosts():
    host, last = np.array([0, 0, 1, 1, 2]), np.array([0, 0, deferral.NEVER, deferral.NEVER, 50])
    assert deferral.slots(np.array([5, 6, 7, 8, 99]), 10, last, host).tolist() == [10, 20, 7, 17, 99]


def test_many_hosts_share_the_state_of_a_group(spark, store, tmp_path):
    rng = random.Random(4)
    hosts = [f"h{k:04}" for k in range(1500)]
    first = [(host, f"u{n}", at(rng.randrange(10_000))) for host in hosts for n in range(2)]
    second = [(rng.choice(hosts), f"v{k:03}", at(rng.randrange(9_000, 20_000))) for k in range(300)]
    stream = deferral.deferred_stream(source(spark, str(tmp_path / "in"), [first, second, [("end", "end", at(10_000_000))]], ATTEMPT), 700, late="5 seconds", groups=8)
    query = stream.writeStream.format("memory").queryName("deferred_groups").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert sorted(map(tuple, spark.table("deferred_groups").collect())) == grants(first + second, 700)
    assert max(state["numRowsTotal"] for p in query.recentProgress for state in p["stateOperators"]) < 100  # by host, at least 1500


def test_attempts_of_one_millisecond_keep_their_order(spark, store, tmp_path):
    first = [("a", "z", T0 + timedelta(microseconds=100)), ("a", "b", T0 + timedelta(microseconds=200))]
    got = run(spark, deferral.deferred_stream(source(spark, str(tmp_path / "in"), [first, [("end", "end", at(10_000_000))]], ATTEMPT), 700, late="5 seconds"), "deferred_micros")
    assert [(r.url, r.granted) for r in sorted(got, key=lambda r: r.granted)] == [("z", at(0)), ("b", at(700))]


def test_deferral_does_not_depend_on_the_time_zone(spark, store, tmp_path):
    night = datetime(2024, 11, 3, 5, 30)  # the hour that New York has twice
    first = [("a", f"u{k}", night + timedelta(minutes=20 * k)) for k in range(6)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = run(spark, deferral.deferred_stream(source(spark, str(tmp_path / "in"), [first, [("end", "end", night + timedelta(days=9))]], ATTEMPT), 1_800_000, late="5 seconds"), "deferred_zone")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted(map(tuple, got)) == grants(first, 1_800_000)


def test_attempts_of_a_busy_host_are_all_sent_by_the_query(spark, store, tmp_path):
    events = spark.range(130_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 1000 == 0, 2).otherwise(1).cast("long").alias("user_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 7919).alias("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))  # a pause of six hours puts the last grant into the year 2112
    got, want = ordered.deferred_stream(spark, str(tmp_path)), ordered.deferred(spark, str(tmp_path))
    assert got.count() == 130_000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


class Store:
    """The state of one group as the processor sees it, with its timers."""

    def __init__(self):
        self.states, self.timers = {}, set()
        self.listTimers, self.deleteTimer, self.registerTimer = lambda: iter(sorted(self.timers)), self.timers.discard, self.timers.add

    def getListState(self, name, schema):
        return self.states.setdefault(name, State([]))

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State(()))


class State:
    def __init__(self, none):
        self.none = self.value = none

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def exists(self):
        return bool(self.value)

    def appendList(self, more):
        self.value = self.value + more

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = self.none


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_group_grants_in_any_batches_what_is_granted_at_once():
    for seed in range(60):
        rng = random.Random(seed)
        pause, spread, hosts = rng.choice([1, 7, 50]), rng.choice([3, 40, 400]), rng.choice(["a", "abcde"])
        store, queues = Store(), deferral._Queues(pause)
        queues.init(store)
        now, seen, out = 0, [], []
        for k in range(14):
            before, now = now, now + rng.choice([0, 1, pause, spread])
            came = [(rng.choice(hosts), rng.choice([None, "u", "v", f"w{k}"]), before * 1000 + rng.randrange(spread * 1000)) for _ in range(rng.choice([0, 1, 12]))]
            if k == 13:
                came, now = [], 10**9
            if came:
                out += queues.handleInputRows((0,), iter([pd.DataFrame(came[n : n + 5], columns=["host", "url", "asked"]) for n in range(0, len(came), 5)]), Clock(now))
            for timer in [t for t in sorted(store.timers) if t < now]:
                out += queues.handleExpiredTimer((0,), Clock(now), None)
                store.timers.discard(timer)
            seen += came
        got = [(host, None if pd.isna(url) else url, asked, granted) for frame in out for host, url, asked, granted in frame.itertuples(index=False)]
        last, want = {}, []
        for host, url, asked in sorted(seen, key=lambda r: (r[2], r[1] is not None, r[1] or "")):
            last[host] = max(asked // 1000, last.get(host, -pause) + pause)
            want.append((host, url, asked, last[host]))
        assert sorted(got, key=repr) == sorted(want, key=repr), seed
        assert not store.timers and not store.states["waiting"].exists(), seed
        for host in hosts:
            assert (mine := [r[3] for r in got if r[0] == host]) == sorted(mine), seed


def test_streams_meet_as_tables_do(spark, rows, tmp_path):
    rng = random.Random(3)
    pick = lambda k, what: [(rng.choice([1, 2, None]), at(rng.randrange(k * 60_000, k * 60_000 + 90_000)), f"{what}{k}-{n}") for n in range(20)]
    hits, pings = [pick(k, "h") for k in range(4)], [pick(k, "p") for k in range(4)]
    kinds = "user_id long, ts timestamp, {} string"
    a, b = source(spark, str(tmp_path / "a"), hits, kinds.format("hit")), source(spark, str(tmp_path / "b"), pings, kinds.format("ping"))
    got = run(spark, joins.within_time(a, b, within="20 seconds", late="5 minutes"), "met")
    tables = [spark.createDataFrame([r for f in files for r in f], kinds.format(n)) for files, n in ((hits, "hit"), (pings, "ping"))]
    want = rows(joins.within_time(*tables, within="20 seconds"))
    assert sorted(map(tuple, got), key=repr) == want
    assert want == sorted(((*h, p[1], p[2]) for f in hits for h in f for g in pings for p in g if h[0] is not None and h[0] == p[0] and timedelta(0) <= h[1] - p[1] <= timedelta(seconds=20)), key=repr)


def test_hits_without_a_ping(spark, tmp_path):
    kinds = "user_id long, ts timestamp, {} string"
    a = source(spark, str(tmp_path / "a"), [[(1, at(0), "x"), (2, at(1000), "y")], [(9, at(10**7), "end")], [(9, at(2 * 10**7), "end")]], kinds.format("hit"))
    b = source(spark, str(tmp_path / "b"), [[(1, at(0), "p")], [(9, at(10**7), "end")], [(9, at(2 * 10**7), "end")]], kinds.format("ping"))
    got = run(spark, joins.within_time(a, b, within="5 seconds", late="1 second", outer=True), "outer")
    assert sorted((r.user_id, r.hit, r.ping) for r in got if r.user_id < 9) == [(1, "x", "p"), (2, "y", None)]


def test_late_rows_are_told(spark, tmp_path):
    kinds = "user_id long, ts timestamp, hit string"
    files = [[(1, at(0), "a"), (1, at(100_000), "b")], [(1, at(95_000), "late but in time"), (2, None, "no time")], [(1, at(50_000), "too late"), (2, at(80_000), "too late"), (3, at(200_000), "c")]]
    got = run(spark, joins.late_rows(source(spark, str(tmp_path / "in"), files, kinds), late="10 seconds"), "late")
    assert sorted((r.user_id, r.hit) for r in got) == [(1, "too late"), (2, "too late")]
    assert got[0].__fields__ == ["user_id", "ts", "hit"]
