"""Incremental and continuous forms: upserting micro-batches, hourly slot counts, anchored windows with state."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from weekcell.functions.calendar import hour_of_week, index_label, month_index, month_label
from weekcell.operators.incidents import WINDOW
from weekcell.sources.store import ingest_rows

STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP, so the wall clock is cast (session zone UTC keeps its digits)."""
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)


def hourly_counts(stream: DataFrame, ts: str = "ts", delay: str = "15 minutes") -> DataFrame:
    """(cell, hour_start, month, hour_of_week, n): tumbling hours, final once the watermark has passed."""
    counts = (with_event_time(stream, ts, delay).groupBy("cell", F.window("event_time", "1 hour"))
              .agg(F.count("*").alias("n")))
    start = F.col("window.start").cast("timestamp_ntz")
    return counts.select("cell", start.alias("hour_start"), index_label(month_index(start)).alias("month"),
                         hour_of_week(start).alias("hour_of_week"), "n")


class AnchoredWindows(StatefulProcessor):
    """Anchored windows of a cell, the same as a batch over all its events would open.

    Events wait in a buffer until the watermark has passed them: no earlier one can come any more, so they are taken in the order of time however they
    arrived. A window closes when an event lies past its end or when the watermark does. State of a cell: the times that wait, folded to
    (time, count), and the open window. One event-time timer is set to when the next waiting event, or the end of the
    open window, is passed, so a quiet cell is flushed too. Rows without a cell only move the watermark.
    """

    def __init__(self, window: timedelta = WINDOW):
        self.window_us = int(window / timedelta(microseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "anchor bigint, n bigint")
        self.waiting = handle.getListState("waiting", "t bigint, n bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    def _release(self, key: tuple, passed_us: int) -> pd.DataFrame | None:
        """Take the waiting events up to ``passed_us``; windows that are closed by then, as columns (None: no window)."""
        held = np.array(list(self.waiting.get()), dtype=np.int64).reshape(-1, 2) if self.waiting.exists() else np.zeros((0, 2), np.int64)
        due, later = held[held[:, 0] <= passed_us], held[held[:, 0] > passed_us]
        due = due[np.argsort(due[:, 0], kind="stable")]
        times, running = due[:, 0].tolist(), [0, *np.cumsum(due[:, 1]).tolist()]
        anchor, n = (int(v) for v in self.open.get()) if self.open.exists() else (None, 0)
        starts, counts, at = [], [], 0
        while True:
            if anchor is not None:
                end = bisect_right(times, anchor + self.window_us, at)
                n += running[end] - running[at]
                at = end
                if at == len(times) and anchor + self.window_us > passed_us:
                    break
                starts.append(anchor)
                counts.append(n)
                anchor, n = None, 0
            if at == len(times):
                break
            anchor = times[at]
        if len(due):
            self._keep(self.waiting, [tuple(v) for v in later.tolist()])
        if anchor is None:
            self.open.clear()
        else:
            self.open.update((anchor, n))
        ahead = ([] if anchor is None else [anchor + self.window_us]) + ([int(later[:, 0].min())] if len(later) else [])
        self._set_timer(min(ahead, default=None))
        return pd.DataFrame({"cell": key[0], "start": np.array(starts, dtype="datetime64[us]"), "n_events": counts}) if starts else None

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _set_timer(self, us: int | None) -> None:
        at = None if us is None else us // 1000 + 1
        before = int(self.timer.get()[0]) if self.timer.exists() else None
        if before == at:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        for part in rows:  # folded as they come, so a micro-batch of a crowded cell is never held whole
            times = part["event_time"].dt.tz_localize(None).astype("datetime64[us]").astype("int64").to_numpy()
            self.waiting.appendList(list(zip(*[v.tolist() for v in np.unique(times, return_counts=True)])))
        done = self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)
        if done is not None:
            yield done

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        done = self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)
        if done is not None:
            yield done

    def close(self) -> None:
        pass


def live_incidents(stream: DataFrame, ts: str = "ts", delay: str = "15 minutes", window: timedelta = WINDOW) -> DataFrame:
    """Closed anchored windows (cell, start, n_events) of a stream of (cell, ts), in any order within ``delay``.

    A window comes out once the watermark has passed its end: a feed that ends with a row without cell and a time past all windows gives every window.
    """
    timed = with_event_time(stream.select("cell", ts), ts, delay).where(F.col(ts).isNotNull())
    return (timed.select("cell", "event_time").groupBy("cell")
            .transformWithStateInPandas(
                statefulProcessor=AnchoredWindows(window), outputStructType="cell string, start timestamp_ntz, n_events bigint",
                outputMode="Append", timeMode="EventTime"))


@contextmanager
def state_store(spark: SparkSession):
    """The state store that these streams need, set for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE_CONF}
    for k, v in STATE_STORE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def upsert_stream(stream: DataFrame, store: str, checkpoint: str, ts: str = "created_date", key: str = "unique_key",
                  now: datetime | None = None) -> StreamingQuery:
    """Drain the available files into the month store: each micro-batch is one idempotent upsert.

    Late rows land in the month they belong to; only touched months are rewritten.
    A row delivered twice in one batch counts once; two versions of a key in one batch fail, since neither is known to be newer.
    """

    def one(batch: DataFrame, _epoch: int) -> None:
        months = [r["m"] for r in batch.select(month_label(ts).alias("m")).distinct().collect()]  # calendar-sized
        if months:
            ingest_rows(batch.sparkSession, store, batch.distinct(), sorted(months),
                        now or datetime.now(timezone.utc), ts, key)

    return (stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
