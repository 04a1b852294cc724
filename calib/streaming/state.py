"""Stateful streams: job states that expire, and running totals over closed windows.

State is kept per job or run in the streaming state store, so a batch reads and writes only
what it touches.  Both need the RocksDB state store; ``keyed_state`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, ROCKSDB)


# -- job states --------------------------------------------------------------

class LatestState(StatefulProcessor):
    """Last state of a job; forgotten when the job leaves the queue or stays silent too long."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "state string, us long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = pd.concat(list(rows))
        last = now.loc[now["us"].idxmax()]
        known = self.latest.get() if self.latest.exists() else None
        if known is not None:
            if known[1] > last["us"]:
                return
            self.handle.deleteTimer(known[2])
        state = last["state"] if pd.notna(last["state"]) else None
        us = int(last["us"])
        if state is None:
            self.latest.clear()
        else:
            due = us // 1000 + self.wait_ms
            self.latest.update((state, us, due))
            self.handle.registerTimer(due)
        yield pd.DataFrame({"job_id": [key[0]], "state": [state], "us": [us], "expired": [False]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known = self.latest.get()
        self.latest.clear()
        yield pd.DataFrame({"job_id": [key[0]], "state": [known[0]], "us": [known[1]], "expired": [True]})

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, wait_seconds: int, delay: str = "0 seconds") -> DataFrame:
    """(job_id, state, us, expired): each change of a job's last state, for update mode.

    ``events``: job_id, state, ts.  A job without events for ``wait_seconds`` of event time comes
    out once more as expired, and its state is dropped; so is that of a job with a NULL state.
    """
    keyed_state(events.sparkSession)
    rows = events.select("job_id", "state", F.col("ts").cast("timestamp").alias("ts")).withColumn(
        "us", F.unix_micros("ts")).withWatermark("ts", delay)
    kind = events.schema["job_id"].dataType.simpleString()
    return rows.groupBy("job_id").transformWithStateInPandas(
        LatestState(wait_seconds * 1000), f"job_id {kind}, state string, us long, expired boolean", "Update",
        "EventTime")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of each job: (job_id, state, us, expired)."""
    last = F.max_by(F.struct("state", "us", "expired"), F.struct("us", "expired"))
    return changes.groupBy("job_id").agg(last.alias("c")).select("job_id", "c.*")


# -- time left ---------------------------------------------------------------

class RunningCount(StatefulProcessor):
    """Steps and first step of a run over its closed windows."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "done long, first_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        closed = pd.concat(list(rows)).sort_values("start_us")
        done, first = self.total.get() if self.total.exists() else (0, int(closed["first_us"].iloc[0]))
        first = min(first, int(closed["first_us"].min()))
        closed["done"] = done + closed["steps"].cumsum()
        closed["begin_us"] = first
        self.total.update((int(closed["done"].iloc[-1]), first))
        yield closed.assign(**dict(zip(self.keys, key)))[
            [*self.keys, "start_us", "steps", "last_us", "done", "begin_us"]]

    def close(self) -> None:
        pass


def time_left_stream(marks: DataFrame, keys: Sequence[str], seconds: int, total: int, delay: str = "1 hour"
                     ) -> DataFrame:
    """(keys, window_start, steps, rate, done, eta_seconds) of each closed window, for append mode.

    The count of a run goes on from window to window; a window comes out once, when the
    watermark has passed its end.
    """
    keyed_state(marks.sparkSession)
    keys = list(keys)
    win = F.window("ts", f"{seconds} seconds")
    rows = marks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(
        win.alias("w"), *keys).agg(F.count(F.lit(1)).alias("steps"), F.min(F.unix_micros("ts")).alias("first_us"),
                                   F.max(F.unix_micros("ts")).alias("last_us"))
    rows = rows.select(*keys, F.unix_micros("w.start").alias("start_us"), "steps", "first_us", "last_us")
    kept = ", ".join(f"`{k}` {marks.schema[k].dataType.simpleString()}" for k in keys)
    out = rows.groupBy(*keys).transformWithStateInPandas(
        RunningCount(keys), f"{kept}, start_us long, steps long, last_us long, done long, begin_us long", "Append",
        "None")
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return out.select(
        *keys, F.timestamp_micros("start_us").alias("window_start"), "steps", (F.col("steps") / float(seconds)).alias("rate"),
        "done", ((F.col("last_us") - F.col("begin_us")) / 1e6 / F.col("done") * left).alias("eta_seconds"))
