"""Two streams joined in time, and what comes too late for that."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Groups that late rows are looked for in; a key has no group of its own.
GROUPS = 64


def within_time(hits: DataFrame, pings: DataFrame, key: str = "user_id", ts: str = "ts", within: str = "1 hour", late: str = "10 minutes", outer: bool = False) -> DataFrame:
    """Each hit with each ping of its key that came at its time or up to ``within`` before: the columns of ``hits``, then those of ``pings`` but ``key``, with ``ts`` as ``ping_ts``.

    For streams and stored tables alike; other columns have different names,
    ``ts`` is a timestamp. A stream keeps both sides until the watermark
    (``late`` behind) has passed what can still meet them, and drops rows that
    are older than it: ``late_rows`` tells which. ``outer``: a hit without a ping comes
    too, with nulls, once none can come. Rows with a null key or time meet nothing.
    """
    rest = [F.col(c) for c in pings.columns if c not in (key, ts)]
    others = pings.select(F.col(key).alias("_key"), F.col(ts).alias("ping_ts"), *rest)
    if hits.isStreaming:
        hits, others = hits.withWatermark(ts, late), others.withWatermark("ping_ts", late)
    meets = (F.col(key) == F.col("_key")) & (F.col(ts) >= F.col("ping_ts")) & (F.col(ts) <= F.col("ping_ts") + F.expr(f"INTERVAL {within}"))
    return hits.join(others, meets, "left_outer" if outer else "inner").drop("_key")


def late_rows(stream: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The rows of a stream that come after the watermark (``late`` behind) has passed them: those that operators with state drop.

    For a side output: a query of its own, over the same source in the same
    batches. It keeps no state, and rows are dealt by their content, so no key
    gathers. Rows without a time are never late.
    """
    names, schema = stream.columns, stream.schema

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        for batch in batches:
            yield batch.loc[batch[ts] < passed, names]

    dealt = stream.withWatermark(ts, late).withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(GROUPS))).groupBy("_group")
    return dealt.applyInPandasWithState(run, schema, "nothing int", "append", "NoTimeout")
