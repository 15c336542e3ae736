"""Billing queue: membership intervals, depth, joins, abandonments, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.config import QueueConfig
from dwellgrid.functions.scoring import seconds_between
from dwellgrid.operators.ordered import OrderedRows
from dwellgrid.session import cut_lineage

VISITOR = ["store_id", "visitor_id"]


def queue_intervals(events: DataFrame, cfg: QueueConfig = QueueConfig()) -> DataFrame:
    """Stay of every queue member: until the visitor's next event, or until the abandon limit when that
    comes first and no purchase follows."""
    rows = OrderedRows.of(
        events.select(*VISITOR, "ts", "event_id", "zone_id", "event_type"), VISITOR, ["ts", "event_id"]
    ).lead({"next_ts": "ts", "next_type": "event_type"}).result()
    joins = rows.where(F.col("event_type") == "BILLING_QUEUE_JOIN")
    limit = F.timestamp_micros(F.unix_micros("ts") + cfg.abandon_seconds * 1_000_000)
    sold = F.coalesce(F.col("next_type") == "PURCHASE", F.lit(False))
    abandoned = ~sold & (F.col("next_ts").isNull() | (F.col("next_ts") >= limit))
    return joins.select(
        *VISITOR, "zone_id", "event_id", F.col("ts").alias("join_time"), sold.alias("transacted"),
        abandoned.alias("abandoned"), F.when(abandoned, limit).otherwise(F.col("next_ts")).alias("leave_time"),
    )


def queue_depth(intervals: DataFrame) -> DataFrame:
    """Depth of each store's queue after every change; at equal times people leave before others join."""
    change = F.array(
        F.struct(F.col("join_time").alias("ts"), F.lit(1).alias("delta")),
        F.struct(F.col("leave_time").alias("ts"), F.lit(-1).alias("delta")),
    )
    moves = cut_lineage(
        intervals.select("store_id", "visitor_id", "event_id", F.inline(change)).where(F.col("ts").isNotNull())
    )
    rows = OrderedRows.of(moves, ["store_id"], ["ts", "delta", "event_id"]).running_sum("depth", F.col("delta")).result()
    return rows.withColumn("depth", F.col("depth").cast("long"))


def queue_joins(depths: DataFrame, cfg: QueueConfig = QueueConfig()) -> DataFrame:
    """BILLING_QUEUE_JOIN when the queue was already active before this person arrived."""
    return depths.where((F.col("delta") == 1) & (F.col("depth") - 1 >= cfg.density_threshold)).select(
        "store_id", "visitor_id", "ts", "event_id", F.lit("BILLING_QUEUE_JOIN").alias("event_type"),
        F.col("depth").alias("queue_depth"),
    )


def queue_abandons(intervals: DataFrame) -> DataFrame:
    return intervals.where("abandoned").select(
        "store_id", "visitor_id", "event_id", F.lit("BILLING_QUEUE_ABANDON").alias("event_type"),
        F.col("leave_time").alias("ts"), seconds_between(F.col("leave_time"), F.col("join_time")).alias("dwell_seconds"),
    )


def queue_snapshot(intervals: DataFrame, at: Column, cfg: QueueConfig = QueueConfig()) -> DataFrame:
    """Members of each queue at a time, one row each, with the depth and whether the queue is active."""
    members = intervals.where((F.col("join_time") <= at) & (F.col("leave_time").isNull() | (at < F.col("leave_time"))))
    depth = members.groupBy("store_id").agg(F.count("*").alias("queue_depth"))
    return members.join(depth, "store_id").select(
        "store_id", "queue_depth", (F.col("queue_depth") >= cfg.density_threshold).alias("is_active"),
        "visitor_id", "zone_id", seconds_between(at, F.col("join_time")).alias("wait_seconds"),
    )
