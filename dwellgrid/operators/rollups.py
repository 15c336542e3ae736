"""Hourly and daily store rollups and their incremental maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.scoring import exact_avg, exact_sum
from dwellgrid.operators.funnel import DAY, abandonment_visitors, conversion_rate, not_staff, store_day_funnel
from dwellgrid.operators.sessions import session_dwell, session_fold

HOUR = ["store_id", "hour_bucket"]
SKETCH_BITS = 14
QUEUE_EVENTS = ("BILLING_QUEUE_JOIN", "BILLING_QUEUE_ABANDON")


def queue_depth_of(metadata: Column) -> Column:
    return F.get_json_object(metadata, "$.queue_depth").try_cast("int")


def dwell_seconds_of(metadata: Column) -> Column:
    return F.get_json_object(metadata, "$.dwell_seconds").try_cast("double")


def event_dwell(events: DataFrame) -> Column:
    """Dwell of an event in seconds: from its metadata, else from ``dwell_ms`` where the feed sends it (0 is none)."""
    told = dwell_seconds_of(F.col("metadata_json"))
    if "dwell_ms" not in events.columns:
        return told
    return F.coalesce(told, F.when(F.col("dwell_ms") > 0, F.col("dwell_ms") / 1000))


def hourly_sessions(sessions: DataFrame, as_of: Column, legacy_staff_count: bool = False) -> DataFrame:
    """Sessions by hour of entry. Sessions are unique rows, so plain counts are distinct counts."""
    customer = ~F.col("is_staff")
    staff = customer if legacy_staff_count else F.col("is_staff")
    return (
        session_dwell(sessions, as_of)
        .groupBy("store_id", F.date_trunc("hour", "entry_time").alias("hour_bucket"))
        .agg(
            F.count_if(customer).alias("unique_visitors"),
            F.count_if(staff).alias("staff_count"),
            F.count_if(customer & F.col("is_converted")).alias("conversions"),
            F.coalesce(exact_avg(F.when(customer, F.col("effective_dwell"))), F.lit(0.0)).alias("avg_dwell_seconds"),
            F.count_if("is_reentry").alias("reentry_count"),
        )
    )


def visitor_sketches(events: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """One mergeable sketch of the distinct customers per store hour; the rows that a table keeps."""
    return not_staff(events).groupBy("store_id", F.date_trunc("hour", "ts").alias("hour_bucket")).agg(
        F.hll_sketch_agg("visitor_id", bits).alias("visitors"), F.count("*").alias("events")
    )


def distinct_visitors(sketches: DataFrame, *periods: Column) -> DataFrame:
    """Distinct customers per store and period (a day, a week, or the store alone) from its hours' sketches.

    Hours are merged, never added: who stays two hours counts once. The standard error is 1.04 / sqrt(2^bits); up to some
    thousand visitors the sketches hold them all, and the count is exact."""
    return sketches.groupBy("store_id", *periods).agg(
        F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("visitors"), F.sum("events").alias("events")
    )


def total_levels(events: DataFrame) -> DataFrame:
    """Events, distinct customers and revenue per store hour, store day, store and chain, from one pass.

    ``level`` is hour, day, store or chain; columns below the level are null."""
    rows = not_staff(events).select(
        "store_id", "event_date", F.hour("ts").alias("hour"), "visitor_id",
        F.when(F.col("event_type") == "PURCHASE", F.col("value")).alias("amount"),
    )
    names = F.create_map(*(F.lit(x) for pair in ((0, "hour"), (1, "day"), (3, "store"), (7, "chain")) for x in pair))
    return rows.rollup("store_id", "event_date", "hour").agg(
        F.grouping_id().alias("g"), F.count("*").alias("events"), F.count_distinct("visitor_id").alias("visitors"),
        F.coalesce(exact_sum(F.col("amount")), F.lit(0.0)).alias("revenue"),
    ).withColumn("level", names[F.col("g").cast("int")]).drop("g")


def hourly_queue(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("event_type").isin(*QUEUE_EVENTS))
        .groupBy("store_id", F.date_trunc("hour", "ts").alias("hour_bucket"))
        .agg(
            F.coalesce(F.max(queue_depth_of(F.col("metadata_json"))), F.lit(0)).alias("max_queue_depth"),
            F.count_if(F.col("event_type") == "BILLING_QUEUE_ABANDON").alias("abandonment_count"),
        )
    )


def hourly_revenue(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("store_id", F.date_trunc("hour", "ts").alias("hour_bucket")).agg(
        F.coalesce(exact_sum(F.col("amount")), F.lit(0.0)).alias("total_revenue")
    )


def hourly_zone_dwell(events: DataFrame) -> DataFrame:
    """Map of zone to average dwell per store and hour (one entry per zone of the store)."""
    dwell = event_dwell(events)
    per_zone = (
        events.where((F.col("event_type") == "ZONE_DWELL") & F.col("zone_id").isNotNull())
        .groupBy("store_id", F.date_trunc("hour", "ts").alias("hour_bucket"), "zone_id")
        .agg(exact_avg(dwell).alias("avg_dwell"))
    )
    entries = F.sort_array(F.collect_list(F.struct("zone_id", "avg_dwell")))
    return per_zone.groupBy(*HOUR).agg(F.map_from_entries(entries).alias("zone_dwell"))


def hourly_metrics(
    events: DataFrame, sessions: DataFrame, transactions: DataFrame, as_of: Column, legacy_staff_count: bool = False
) -> DataFrame:
    """Every store and hour that has a session, a queue event, a sale or a dwell; absent parts are 0."""
    parts = [
        hourly_sessions(sessions, as_of, legacy_staff_count),
        hourly_queue(events),
        hourly_revenue(transactions),
        hourly_zone_dwell(events),
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, HOUR, "full")
    filled = joined.fillna(0)
    empty = F.create_map().cast("map<string,double>")
    return filled.withColumn("zone_dwell", F.coalesce("zone_dwell", empty))


def daily_metrics(hourly: DataFrame, weighted_dwell: bool = False) -> DataFrame:
    """Day rollup of the hourly rows; average dwell is the plain mean of the hourly means unless weighted."""
    visitors = F.col("unique_visitors")
    if weighted_dwell:
        dwell = exact_sum(F.col("avg_dwell_seconds") * visitors) / F.nullif(F.sum(visitors), F.lit(0))
    else:
        dwell = exact_avg(F.col("avg_dwell_seconds"))
    hour = F.hour("hour_bucket")
    out = hourly.groupBy("store_id", F.to_date("hour_bucket").alias("event_date")).agg(
        F.sum("unique_visitors").alias("unique_visitors"),
        F.sum("staff_count").alias("staff_count"),
        F.sum("conversions").alias("conversions"),
        F.round(F.coalesce(dwell, F.lit(0.0)), 4).alias("avg_dwell_seconds"),
        F.max("max_queue_depth").alias("max_queue_depth"),
        F.sum("abandonment_count").alias("abandonment_count"),
        F.sum("reentry_count").alias("reentry_count"),
        exact_sum(F.col("total_revenue")).alias("total_revenue"),
        F.max_by(hour, F.struct(visitors, -hour)).alias("peak_hour"),
    )
    return out.withColumn("conversion_rate", daily_conversion_rate())


def daily_conversion_rate() -> Column:
    v = F.col("unique_visitors")
    return F.when(v > 0, F.round(F.col("conversions") / F.when(v > 0, v), 4)).otherwise(0.0)


def peak_hour(hourly: DataFrame) -> DataFrame:
    """Hour with most visitors; the earliest on a tie."""
    hour = F.hour("hour_bucket")
    return hourly.groupBy("store_id", F.to_date("hour_bucket").alias("event_date")).agg(
        F.max_by(hour, F.struct("unique_visitors", -hour)).alias("peak_hour")
    )


def hourly_breakdown(hourly: DataFrame) -> DataFrame:
    rate = F.round(F.col("conversions") / F.greatest(F.lit(1), F.col("unique_visitors")), 4)
    return hourly.select(
        "store_id", F.to_date("hour_bucket").alias("event_date"), "hour_bucket",
        "unique_visitors", "conversions", rate.alias("conversion_rate"),
    )


def hourly_lists(hourly: DataFrame) -> DataFrame:
    """Hourly rows nested per store and day (24 at most)."""
    item = F.struct("hour_bucket", "unique_visitors", "conversions", "conversion_rate")
    return hourly_breakdown(hourly).groupBy(*DAY).agg(F.sort_array(F.collect_list(item)).alias("hourly_breakdown"))


def live_supplementary(sessions: DataFrame, transactions: DataFrame, as_of: Column) -> DataFrame:
    """Staff count, average dwell and revenue per store and day, straight from the base tables."""
    customer = ~F.col("is_staff")
    base = (
        session_dwell(sessions, as_of).groupBy("store_id", F.to_date("entry_time").alias("event_date"))
        .agg(
            F.count_if("is_staff").alias("staff_count"),
            F.coalesce(exact_avg(F.when(customer, F.col("effective_dwell"))), F.lit(0.0)).alias("avg_dwell_seconds"),
        )
    )
    revenue = transactions.groupBy("store_id", F.to_date("ts").alias("event_date")).agg(
        exact_sum(F.col("amount")).alias("total_revenue")
    )
    return base.join(revenue, DAY, "left").fillna(0.0, ["total_revenue"])


def store_metrics(
    events: DataFrame, daily: DataFrame, live: DataFrame, hourly: DataFrame
) -> DataFrame:
    """One wide row per store and day; daily figures win over the live fallback."""
    d = daily.select(
        *DAY, *[F.col(c).alias("d_" + c) for c in ("staff_count", "avg_dwell_seconds", "total_revenue")],
        "peak_hour", "max_queue_depth", F.lit(True).alias("has_daily"),
    )
    live_cols = live.select(*DAY, *[F.col(c).alias("l_" + c) for c in ("staff_count", "avg_dwell_seconds", "total_revenue")])
    out = (
        store_day_funnel(events).join(d, DAY, "left").join(live_cols, DAY, "left")
        .join(abandonment_visitors(events), DAY, "left").join(hourly_lists(hourly), DAY, "left")
    )
    picked = [
        F.coalesce(F.when(F.col("has_daily"), F.col("d_" + c)), F.col("l_" + c), F.lit(0)).alias(c)
        for c in ("staff_count", "avg_dwell_seconds", "total_revenue")
    ]
    return out.select(
        *DAY, "unique_visitors", "entry_count", "exit_count", "reentry_count", "zone_engagement_count",
        "billing_queue_count", "purchases_count",
        conversion_rate(F.col("purchases_count"), F.col("entry_count")).alias("conversion_rate"),
        (F.col("cross_camera_visitors") / F.col("unique_visitors")).alias("cross_camera_match_rate"),
        *picked, "peak_hour", F.coalesce("max_queue_depth", F.lit(0)).alias("max_queue_depth"),
        F.coalesce("abandonment_visitors", F.lit(0)).alias("abandonment_count"), "hourly_breakdown",
    )


def refreshed_hours(
    events: DataFrame, touched: DataFrame, transactions_of: Callable[[DataFrame], DataFrame], as_of: Column
) -> DataFrame:
    """Hourly rows of the touched store hours, from the events of the touched store days alone."""
    base = events.join(touched.select("store_id", "event_date").distinct(), DAY, "left_semi")
    fresh = hourly_metrics(base, session_fold(base), transactions_of(base), as_of)
    return fresh.join(touched.select(*HOUR).distinct(), HOUR, "left_semi").withColumn("event_date", F.to_date("hour_bucket"))


def refreshed_days(
    events: DataFrame, touched: DataFrame, transactions_of: Callable[[DataFrame], DataFrame], as_of: Column
) -> DataFrame:
    """Daily rows of the touched store days, from their events alone."""
    base = events.join(touched.select("store_id", "event_date").distinct(), DAY, "left_semi")
    return daily_metrics(hourly_metrics(base, session_fold(base), transactions_of(base), as_of))


def affected_buckets(batch: DataFrame) -> DataFrame:
    """Distinct store hours touched by a batch of events."""
    return batch.select(
        "store_id", F.date_trunc("hour", "ts").alias("hour_bucket"), F.to_date("ts").alias("event_date")
    ).distinct()
