"""Visitor sessions: fold of events, dwell, inactivity sessions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.config import ReidConfig
from dwellgrid.functions.hashing import session_key
from dwellgrid.functions.scoring import seconds_between
from dwellgrid.operators.ordered import OrderedRows
from dwellgrid.operators.trajectory import reentry_flag


def with_session_id(events: DataFrame, seq: Column | None = None) -> DataFrame:
    """Deterministic session id of visitor, store, UTC day and visit number (0 by default)."""
    seq = F.lit(0) if seq is None else seq
    return events.withColumn("session_id", session_key(F.col("visitor_id"), F.col("store_id"), F.to_date("ts"), seq))


def with_visit_sessions(events: DataFrame, cfg: ReidConfig = ReidConfig()) -> DataFrame:
    """Session ids by visit: a re-entry (back after the cooldown, within the window) opens a session of its own.

    ``visit_no`` counts a visitor's re-entries in a store; one shuffle by visitor carries the whole events."""
    rows = OrderedRows.of(events, ["store_id", "visitor_id"], ["ts", "event_id"]).lag({"prev_ts": "ts"})
    numbered = rows.running_sum("visit_no", F.when(reentry_flag(cfg), 1).otherwise(0)).result().drop("prev_ts")
    numbered = numbered.withColumn("visit_no", F.col("visit_no").cast("long"))
    return with_session_id(numbered, F.col("visit_no"))


def session_fold(events: DataFrame) -> DataFrame:
    """One row per session. Zones are folded per (session, zone) first, so the array holds distinct zones only."""
    per_zone = events.groupBy("session_id", "store_id", "visitor_id", "zone_id").agg(
        F.min("ts").alias("first_ts"),
        F.max(F.when(F.col("event_type") == "EXIT", F.col("ts"))).alias("exit_ts"),
        F.bool_or("is_staff").alias("is_staff"),
        F.bool_or(F.col("event_type") == "REENTRY").alias("is_reentry"),
        F.bool_or(F.col("event_type") == "PURCHASE").alias("is_converted"),
    )
    folded = per_zone.groupBy("session_id", "store_id", "visitor_id").agg(
        F.min("first_ts").alias("entry_time"),
        F.max("exit_ts").alias("exit_time"),
        F.bool_or("is_staff").alias("is_staff"),
        F.bool_or("is_reentry").alias("is_reentry"),
        F.bool_or("is_converted").alias("is_converted"),
        F.sort_array(
            F.collect_list(F.when(F.col("zone_id").isNotNull(), F.struct("first_ts", "zone_id")))
        ).alias("_zones"),
    )
    return folded.select(
        "session_id", "store_id", "visitor_id", "entry_time", "exit_time",
        seconds_between(F.col("exit_time"), F.col("entry_time")).alias("dwell_seconds"),
        "is_converted", "is_staff", "is_reentry",
        F.transform("_zones", lambda z: z["zone_id"]).alias("zones_visited"),
    )


def session_dwell(sessions: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``effective_dwell``: closed sessions keep their dwell, open ones last until ``as_of``."""
    open_dwell = seconds_between(as_of, F.col("entry_time"))
    return sessions.withColumn("effective_dwell", F.coalesce("dwell_seconds", open_dwell))


def sessions_by_gap(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions split where a visitor is silent for at least ``gap_seconds``."""
    rows = OrderedRows.of(
        events.select("store_id", "visitor_id", "ts", "event_id"), ["store_id", "visitor_id"], ["ts", "event_id"]
    ).lag({"prev_ts": "ts"})
    gap = seconds_between(F.col("ts"), F.col("prev_ts"))
    starts = F.when(F.col("prev_ts").isNull() | (gap >= gap_seconds), 1).otherwise(0)
    return (
        rows.running_sum("visit_no", starts).result()
        .groupBy("store_id", "visitor_id", F.col("visit_no").cast("long").alias("visit_no"))
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("events"))
    )
