"""Politeness with a queue: what comes too early for its host waits for its slot, and is sent on then.

The n-th attempt of a host is granted at ``max(its time, pause after the one before)``.
Written out, that is the running maximum of ``time - n * pause``, plus
``n * pause``: one window function for stored attempts, one vector operation for a queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestack.session import make_importable

#: What a host waits between two fetches.
PAUSE_MS = 1000
#: State with timers needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
GRANTED = "host string, url string, asked timestamp, granted timestamp"
#: Groups that share out the hosts of a stream. State is read and written by group, since each call to the store costs
#: milliseconds, whether it is for one attempt or for thousands.
GROUPS = 1024
#: Attempts in one value of a group's state, and in one frame of its output.
CHUNK = 65_536
#: The last grant of a host that has none.
NEVER = np.iinfo(np.int64).min // 2


def slots(asked: np.ndarray, pause: int, last: int | np.ndarray | None = None, host: np.ndarray | None = None) -> np.ndarray:
    """When attempts in order of time are granted, all in milliseconds; ``last`` is the grant before them.

    For many hosts at once ``host`` numbers the host of each attempt, and ``last`` has that host's last grant, or ``NEVER``, at each.
    """
    host = np.zeros(len(asked), np.int64) if host is None else host
    shift = pd.Series(host).groupby(host).cumcount().to_numpy(np.int64) * pause
    first = asked - shift if last is None else np.maximum(asked - shift, last + pause)
    return pd.Series(first).groupby(host).cummax().to_numpy(np.int64) + shift


def deferred(attempts: DataFrame, pause_ms: int = PAUSE_MS) -> DataFrame:
    """``host, url, asked, granted`` for stored attempts ``host, url, ts``, in the order of (ts, url); attempts without a host or time are left out."""
    queue = Window.partitionBy("host").orderBy("ts", "url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = attempts.where("host is not null and ts is not null").select("host", "url", F.col("ts").cast("timestamp").alias("ts"))
    placed = known.withColumn("shift", (F.count("*").over(queue) - 1) * pause_ms)
    grant = F.max(F.unix_millis("ts") - F.col("shift")).over(queue) + F.col("shift")
    return placed.select("host", "url", F.col("ts").alias("asked"), F.timestamp_millis(grant).alias("granted"))


_WAITING = pa.schema({"host": pa.string(), "asked": pa.int64(), "url": pa.string()})
_LAST = pa.schema({"host": pa.string(), "granted": pa.int64()})


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class _Queues(StatefulProcessor):
    """The attempts of a group's hosts that wait, and the time of each host's last grant as long as it matters."""

    def __init__(self, pause: int) -> None:
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "attempts binary")
        self.last = handle.getValueState("last", "grants binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [pa.Table.from_pandas(batch[_WAITING.names], _WAITING, preserve_index=False) for batch in rows]
        self.waiting.appendList([(_packed(part),) for part in came])
        first, now = min(pc.min(part["asked"]).as_py() for part in came) // 1000, timerValues.getCurrentWatermarkInMs()
        if first < now:
            yield from self._grant(now)
        else:  # nothing new is due
            self._wake(first + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._grant(timerValues.getCurrentWatermarkInMs())

    def _wake(self, at: int | None, anew: bool = False) -> None:
        """Have one timer: at ``at``, or the earlier one that is set, unless ``anew``."""
        timers = list(self.handle.listTimers())
        if not anew and timers and min(timers) <= at:
            return
        for old in timers:
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def _grant(self, now: int) -> Iterator[pd.DataFrame]:
        """Send on what is granted up to ``now``: nothing that comes later can go before it. A timer is set for the next."""
        parts = [_unpacked(r[0]) for r in self.waiting.get()]
        if not parts:
            return
        queue = pa.concat_tables(parts)
        queue = queue.take(pc.sort_indices(queue, sort_keys=[(c, "ascending") for c in _WAITING.names], null_placement="at_start"))
        rows = queue.to_pandas()
        host, hosts = pd.factorize(rows["host"])
        last = _unpacked(self.last.get()[0]).to_pandas().set_index("host")["granted"] if self.last.exists() else pd.Series(dtype="int64")
        grants = slots(rows["asked"].to_numpy() // 1000, self.pause, last.reindex(hosts, fill_value=NEVER).to_numpy(np.int64)[host], host)
        due = grants < now
        self._wake(None if due.all() else int(grants[~due].min()) + 1, anew=True)
        if not due.any():
            return
        rest = queue.filter(pa.array(~due))
        if len(rest):
            self.waiting.put([(_packed(rest.slice(k, CHUNK)),) for k in range(0, len(rest), CHUNK)])
        else:
            self.waiting.clear()
        sent = rows[due].assign(granted=grants[due])
        newest = sent.groupby("host")["granted"].max()
        last = pd.concat([last.drop(newest.index, errors="ignore"), newest])
        last = last[last + self.pause >= now]  # what comes is not before now, and what waits was not granted before now
        if len(last):
            self.last.update((_packed(pa.table([last.index.to_numpy(), last.to_numpy()], schema=_LAST)),))
        else:
            self.last.clear()
        for k in range(0, len(sent), CHUNK):
            yield sent[["host", "url", "asked", "granted"]].iloc[k : k + CHUNK]


def deferred_stream(attempts: DataFrame, pause_ms: int = PAUSE_MS, late: str | None = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """The same for a stream of attempts, which may come up to ``late`` out of order; a later one is dropped. None: they have a watermark on ``ts`` already.

    Hosts are dealt into ``groups``, which stay the same as long as the stream's
    checkpoint is used. A group's state is the queue of its hosts, as Arrow
    batches, and their last grants. Attempts leave when the watermark has
    passed their slot: a timer of event time wakes the group then, so what is
    deferred comes out although nothing new arrives for its host. The session
    needs the settings ``STORE``. Grants are in milliseconds.
    """
    make_importable(attempts.sparkSession)
    known = attempts.where("host is not null and ts is not null").select(
        F.pmod(F.xxhash64("host"), F.lit(groups)).alias("group"), "host", "url", F.unix_micros(F.col("ts").cast("timestamp")).alias("asked"), "ts"
    )
    known = known.withWatermark("ts", late) if late else known
    sent = known.groupBy("group").transformWithStateInPandas(_Queues(pause_ms), "host string, url string, asked long, granted long", "Append", "EventTime")
    return sent.select("host", "url", F.timestamp_micros("asked").alias("asked"), F.timestamp_millis("granted").alias("granted"))
