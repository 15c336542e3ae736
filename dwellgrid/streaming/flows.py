"""Streaming forms that use built-in operators: ingest, deduplication, rollups, sessions, freshness, POS links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.hashing import semantic_key
from dwellgrid.operators.funnel import not_staff
from dwellgrid.operators.quality import split_valid
from dwellgrid.streaming.jobs import DELAY


def timed(events: DataFrame, column: str, delay: str | None) -> DataFrame:
    """Sets the watermark, unless the stream comes with one (``delay`` is None, see ``heartbeat``)."""
    return events if delay is None else events.withWatermark(column, delay)


def ingest(raw: DataFrame, delay: str = DELAY) -> DataFrame:
    """Valid typed events, each event id once."""
    typed = raw.withColumn("timestamp", F.col("ts").cast("string"))
    good, _ = split_valid(typed)
    return good.drop("timestamp").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def dedup_semantic(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """One event per visitor, type and second; the state holds the keys of the watermark delay only."""
    keyed = events.withColumn("dedup_key", semantic_key(F.col("visitor_id"), F.col("event_type"), F.col("ts")))
    keyed = keyed.withColumn("_second", F.date_trunc("second", "ts")).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["visitor_id", "event_type", "_second"]).drop("_second")


def hourly(events: DataFrame, delay: str | None = DELAY) -> DataFrame:
    """Distinct customer sessions per store hour: sessions are made unique per hour, then counted."""
    hours = timed(not_staff(events), "ts", delay).select(
        "store_id", "session_id", F.window("ts", "1 hour").alias("hour")
    )
    unique = hours.dropDuplicates(["store_id", "session_id", "hour"])
    return unique.groupBy("hour", "store_id").agg(F.count("*").alias("active_sessions"))


def daily(events: DataFrame, delay: str | None = DELAY) -> DataFrame:
    """Hourly counts rolled up to days in the same query."""
    by_hour = hourly(events, delay)
    day = F.window(F.window_time("hour"), "1 day")
    return by_hour.groupBy(day.alias("day"), "store_id").agg(
        F.sum("active_sessions").alias("session_hours"), F.max("active_sessions").alias("busiest_hour")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = DELAY) -> DataFrame:
    """Visitor sessions closed by inactivity."""
    window = F.session_window("ts", gap)
    return timed(events, "ts", delay).groupBy(window.alias("span"), "store_id", "visitor_id").agg(
        F.count("*").alias("events"), F.max("ts").alias("end_ts")
    )


def freshness(events: DataFrame) -> DataFrame:
    """Latest event per store; the state is one row per store."""
    return events.groupBy("store_id").agg(F.max("ts").alias("last_event_at"))


def zone_activity(events: DataFrame, delay: str | None = DELAY) -> DataFrame:
    """Customer visits per zone over sliding half hours; a zone absent from a window was dead in it."""
    seen = not_staff(events).where(F.col("event_type").isin("ZONE_ENTER", "ZONE_DWELL"))
    return timed(seen, "ts", delay).groupBy(
        F.window("ts", "30 minutes", "5 minutes").alias("span"), "store_id", "zone_id"
    ).agg(F.count("*").alias("visits"))


def pos_links(entries: DataFrame, transactions: DataFrame, window_seconds: int = 300, delay: str | None = DELAY) -> DataFrame:
    """Latest customer entry within the window before each transaction.

    Both streams meet on store and time bucket, so the join state of one store is spread over many
    partitions; the aggregation keeps one row per transaction."""
    bucket = F.floor(F.unix_seconds("entry_ts") / window_seconds)
    left = (
        timed(entries, "entry_ts", delay)
        .select("store_id", "session_id", "entry_ts", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    )
    right = timed(transactions, "ts", delay).select(
        F.col("store_id").alias("tx_store"), "tx_id", "ts", F.floor(F.unix_seconds("ts") / window_seconds).alias("tx_bucket")
    )
    near = (
        (F.col("store_id") == F.col("tx_store")) & (F.col("bucket") == F.col("tx_bucket"))
        & (F.col("entry_ts") <= F.col("ts")) & (F.col("ts") <= F.col("entry_ts") + F.expr(f"interval {window_seconds} seconds"))
    )
    pairs = left.join(right, near)
    return pairs.groupBy(F.window("ts", f"{window_seconds} seconds").alias("span"), "tx_id", "store_id").agg(
        F.max_by("session_id", F.struct("entry_ts", "session_id")).alias("session_id"), F.max("ts").alias("ts")
    )
