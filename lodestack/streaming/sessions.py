"""Sessions, liveness and throttling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestack.sources.staging import staged

#: A session ends after more than this many idle seconds.
IDLE_SECONDS = 300
#: A worker counts as alive up to this many seconds after its last ping.
ALIVE_SECONDS = 15


def sessions(hits: DataFrame, key: str = "user_id", ts: str = "ts", idle: int = IDLE_SECONDS) -> DataFrame:
    """``key, start, end, n_hits``: runs of hits at most ``idle`` seconds apart. Hits without a time are in none.

    Hits are sorted by range over (key, time), and sessions found in each
    stretch of a key; then only the first and the last session of each stretch
    are set side by side and joined across the borders. So a key with most of
    the hits is cut by many tasks.
    """
    known = hits.select(F.col(key).alias("k"), F.col(ts).alias("t")).where("t is not null")
    placed = staged(known.repartitionByRange("k", "t").withColumn("part", F.spark_partition_id()))
    stretch = Window.partitionBy("k", "part")
    partial = _numbered(placed, "t", "t", stretch.orderBy("t"), idle).groupBy("k", "part", "s").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n_hits"))
    marked = staged(partial.withColumn("border", (F.col("s") == 0) | (F.col("s") == F.max("s").over(stretch))))
    borders = _numbered(marked.where("border").drop("s"), "start", "end", Window.partitionBy("k").orderBy("start"), idle)
    joined = borders.groupBy("k", "s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_hits").alias("n_hits")).drop("s")
    whole = joined.unionByName(marked.where("not border").select("k", "start", "end", "n_hits"))
    return whole.withColumnRenamed("k", key)


def _numbered(spans: DataFrame, start: str, end: str, order: WindowSpec, idle: int) -> DataFrame:
    """``spans`` with the number ``s`` of their run, from 0: one begins where more than ``idle`` seconds lie behind."""
    gap = F.unix_micros(F.col(start).cast("timestamp")) - F.lag(F.unix_micros(F.col(end).cast("timestamp"))).over(order)
    return spans.withColumn("_new", F.when(gap > idle * 1_000_000, 1).otherwise(0)).withColumn("s", F.sum("_new").over(order)).drop("_new")


def session_windows(hits: DataFrame, key: str = "user_id", ts: str = "ts", idle: int = IDLE_SECONDS, late: str | None = None) -> DataFrame:
    """The same for batch or stream by ``session_window``, which merges at exactly ``idle`` seconds and splits above.

    ``late``: the watermark of a stream, how long a hit may be late; a session is emitted once the watermark passes its end.
    """
    if late:
        hits = hits.withWatermark(ts, late)
    grouped = hits.groupBy(F.col(key), F.session_window(ts, f"{idle} seconds").alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_hits"))
    return grouped.select(key, "start", "end", "n_hits")


def liveness(pings: DataFrame, now, key: str = "user_id", ts: str = "ts", alive: int = ALIVE_SECONDS) -> DataFrame:
    """``key, last_ping, active`` at the time ``now`` (a Column or a literal)."""
    moment = now if not isinstance(now, str) else F.lit(now).cast("timestamp")
    last = pings.groupBy(key).agg(F.max(ts).alias("last_ping"))
    return last.withColumn("active", F.unix_millis(moment) - F.unix_millis(F.col("last_ping").cast("timestamp")) <= alive * 1000)


def throttled(hits: DataFrame, key: str = "host", ts: str = "ts", pause_ms: int = 1000, forget_ms: int | None = 600_000) -> DataFrame:
    """A stream of fetch attempts with ``allowed``: false if the host was let through less than ``pause_ms`` before. Attempts without a time are left out.

    The state of a host is one time stamp; it expires after ``forget_ms``
    without attempts (None: never, for a stream that is to end). Within a batch attempts are taken in the order of time.
    """

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        at = (rows[ts].astype("datetime64[us]").astype("int64") // 1000).to_numpy()
        out, next_ = np.zeros(len(at), bool), 0 if last is None else int(np.searchsorted(at, last + pause_ms))
        while next_ < len(at):  # from one attempt that is let through to the next
            out[next_], last = True, int(at[next_])
            next_ = int(np.searchsorted(at, last + pause_ms))
        state.update((last,))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({key: [k[0]] * len(rows), ts: rows[ts].to_numpy(), "allowed": out})

    schema = f"{key} string, {ts} timestamp, allowed boolean"
    return hits.select(key, ts).where(F.col(ts).isNotNull()).groupBy(key).applyInPandasWithState(step, schema, "last long", "append", "ProcessingTimeTimeout" if forget_ms else "NoTimeout")
