"""The set of what was seen, against a plain set."""

import random

import pytest
from pyspark.sql import functions as F

from lodestack.operators import seen
from lodestack.sources.staging import staged


@pytest.mark.parametrize("bits", [seen.SLICE, 1 << 20])
def test_what_is_new_whatever_the_filter(spark, bits, monkeypatch):
    """The small filter is nearly full and knows little as new."""
    monkeypatch.setattr(seen, "MERGED", 2)
    rng, known, held = random.Random(bits), seen.SeenSet(spark, bits), set()
    make = lambda urls: spark.createDataFrame([(u,) for u in urls], "url string").repartition(3)
    for size in (0, 4000, 30_000, 5):
        asked = {f"u{rng.randrange(60_000)}" for _ in range(2000)}
        assert {r.url for r in known.unseen(make(asked)).collect()} == asked - held
        new = [f"u{rng.randrange(60_000)}" for _ in range(size)]
        known.add(staged(make([*new, *new[:5], None])))
        held |= set(new)
    assert {r.url for r in known.read().collect()} == held


def test_only_the_buckets_of_what_may_be_seen_are_read(spark):
    known = seen.SeenSet(spark, 1 << 22)
    known.add(staged(spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("url"))))
    asked = spark.createDataFrame([("u1",), ("u2",), ("new",)], "url string")
    got = known.unseen(asked)
    assert [r.url for r in got.collect()] == ["new"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and len(known.read([3]).inputFiles()) >= 1
    assert {r.bucket for r in known.read([3, 5]).select("bucket").distinct().collect()} == {3, 5}
    fresh = known.unseen(spark.range(20_000, 20_200).select(F.concat(F.lit("u"), "id").alias("url")))
    assert fresh.count() == 200
