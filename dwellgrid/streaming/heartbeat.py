"""Heartbeats: rows that carry only the clock of a feed, so that a stream closes its windows without further events.

A feed that pauses or ends sends its time in a heartbeat; the watermark follows it, and open windows, sessions, joins and
timers close by themselves. Heartbeats raise the watermark and are then dropped: no operator and no sink sees them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.streaming.jobs import DELAY

HEARTBEAT = "is_heartbeat"
BEAT_SCHEMA = "store_id string, ts timestamp"


def with_heartbeats(events: DataFrame, beats: DataFrame) -> DataFrame:
    """Events and the heartbeats (store_id, ts) of their feeds in one stream."""
    marked = events.withColumn(HEARTBEAT, F.lit(False))
    return marked.unionByName(beats.select("store_id", "ts", F.lit(True).alias(HEARTBEAT)), allowMissingColumns=True)


def on_feed_clock(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """The events of a stream under a watermark that heartbeats move as well.

    The condition counts as not deterministic, so that neither it nor a filter above it is moved below the watermark,
    where it would take the heartbeats away before they are counted."""
    kept = F.rand(0) >= F.when(F.col(HEARTBEAT), 2.0).otherwise(0.0)  # a draw lies in [0, 1)
    return stream.withWatermark("ts", delay).where(kept).drop(HEARTBEAT)


def final_heartbeats(events: DataFrame, horizon: str = "3 days") -> DataFrame:
    """One heartbeat per feed that has ended, far enough after its last event to close everything."""
    ends = events.groupBy("store_id").agg(F.max("ts").alias("last"))
    return ends.select("store_id", (F.col("last") + F.expr(f"interval {horizon}")).alias("ts"))
