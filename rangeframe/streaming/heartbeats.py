"""The heartbeat monitor as a stream: silent servers are found by their own timers.

State is one small row per server, kept by Spark's state store; a server is reported when its last heartbeat
is longer ago than the timeout and again when it comes back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rangeframe.plans.cluster import CHECK_SECONDS, TIMEOUT_SECONDS

EVENTS = "server_id string, state string, at timestamp"


def watch(heartbeats: DataFrame, timeout_seconds: int = TIMEOUT_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """A stream of (server_id, state ONLINE or DEAD, at) from a stream of (server_id, ts), in event time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"server_id": [key[0]], "state": ["DEAD"], "at": [pd.Timestamp(last, unit="ms") + pd.Timedelta(seconds=timeout_seconds)]})
            return
        new = max(int(f["ts"].max().timestamp() * 1000) for f in frames)
        fresh = not state.exists
        last = new if fresh else max(new, state.get[0])
        state.update((last,))
        # Timers must lie after the watermark; a heartbeat that is older is silent already.
        state.setTimeoutTimestamp(max(last + timeout_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if fresh:
            yield pd.DataFrame({"server_id": [key[0]], "state": ["ONLINE"], "at": [pd.Timestamp(new, unit="ms")]})

    marked = heartbeats.select("server_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return marked.groupBy("server_id").applyInPandasWithState(step, EVENTS, "last long", "append", "EventTimeTimeout")


def monitor(heartbeats: DataFrame, on_failure: Callable[[str], None], checkpoint: str, timeout_seconds: int = TIMEOUT_SECONDS) -> StreamingQuery:
    """Call ``on_failure(server_id)`` for each server that falls silent; one failing call doesn't stop others."""

    def handle(batch: DataFrame, _: int) -> None:
        for r in batch.where("state = 'DEAD'").orderBy("at", "server_id").toLocalIterator():
            try:
                on_failure(r.server_id)
            except Exception as e:  # noqa: BLE001  # a handler's error belongs to its server alone
                print(f"recovery of {r.server_id} failed: {e}")

    stream = watch(heartbeats, timeout_seconds).writeStream.foreachBatch(handle)
    return stream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{CHECK_SECONDS} seconds").start()
