"""Extension: stages of jobs as keyed state with timers. A stage's start and finish may come in any order, or never.

A stage is done if its first finish lies between its first start and that plus a timeout, else it has timed out; without a start it
is an orphan. ``stages`` says so of a batch, as an aggregate; ``stage_stream`` of a stream, where a stage's row comes
out once, when the watermark passes the end of its timeout: then all that counts has come, so that both agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = "job string, stage string, status string, started timestamp, finished timestamp, seconds bigint"
#: Milliseconds for which a stage whose row has come out is remembered: a finish in this time is no orphan.
REMEMBERED = 24 * 3600 * 1000


def _outcome(start: Column, finish: Column, timeout: int) -> Column:
    in_time = (finish >= start) & (F.unix_millis(finish) <= F.unix_millis(start) + timeout * 1000)
    return F.when(start.isNull(), "orphan").when(in_time, "done").otherwise("timeout")


def stages(events: DataFrame, timeout: int) -> DataFrame:
    """events: job, stage, kind (start or finish; others do not count), ts. A row for each stage; timeout in seconds."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts").cast("timestamp")))
    one = events.filter(F.col("kind").isin("start", "finish") & F.col("ts").isNotNull()).groupBy("job", "stage").agg(first("start").alias("started"), first("finish").alias("first"))
    one = one.withColumn("status", _outcome(F.col("started"), F.col("first"), timeout))
    finished = F.when(F.col("status") != "timeout", F.col("first"))
    return one.withColumn("finished", finished).select("job", "stage", "status", "started", "finished", F.timestamp_diff("SECOND", F.col("started"), F.col("finished")).alias("seconds"))


class _Stage(StatefulProcessor):
    """State of a stage: milliseconds of its first start and finish, and whether its row has come out."""

    def __init__(self, timeout: int) -> None:
        self.timeout = timeout * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stage", "started bigint, finished bigint, closed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        started, finished, closed = self.state.get() if self.state.exists() else (None, None, False)
        for batch in rows:
            for kind, ts in zip(batch["kind"], batch["ts"]):
                at = int(pd.Timestamp(ts).value // 1_000_000)
                if kind == "start":
                    started = at if started is None else min(started, at)
                else:
                    finished = at if finished is None else min(finished, at)
        if not closed:
            self.state.update((started, finished, False))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((finished if started is None else started) + self.timeout)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        started, finished, closed = self.state.get()
        if closed:
            self.state.clear()
            yield pd.DataFrame()
            return
        status = "orphan" if started is None else "done" if finished is not None and started <= finished <= started + self.timeout else "timeout"
        end = None if status == "timeout" else finished
        self.state.update((started, finished, True))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + REMEMBERED)
        when = lambda ms: pd.Timestamp(ms, unit="ms") if ms is not None else pd.NaT
        seconds = None if started is None or end is None else (end - started) // 1000
        yield pd.DataFrame({"job": [key[0]], "stage": [key[1]], "status": [status], "started": [when(started)], "finished": [when(end)], "seconds": pd.array([seconds], "Int64")})

    def close(self) -> None:
        pass


def stage_stream(events: DataFrame, timeout: int, late: str = "1 hour") -> DataFrame:
    """The same of a stream; needs the RocksDB state store. Events later than the watermark by ``late`` are left out."""
    e = events.select("job", "stage", "kind", F.col("ts").cast("timestamp").alias("ts")).filter(F.col("kind").isin("start", "finish") & F.col("ts").isNotNull())
    return e.withWatermark("ts", late).groupBy("job", "stage").transformWithStateInPandas(_Stage(timeout), ROW, "Append", "EventTime")
