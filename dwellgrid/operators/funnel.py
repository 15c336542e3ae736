"""Journey funnel: visitor flags, totals per store and day, stages and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.fixed_values import FUNNEL_STAGES

DAY = ["store_id", "event_date"]


def not_staff(events: DataFrame) -> DataFrame:
    return events.where(~F.col("is_staff"))


def _flag(*types: str) -> Column:
    return F.max(F.when(F.col("event_type").isin(*types), 1).otherwise(0))


def visitor_stages(events: DataFrame) -> DataFrame:
    """0/1 stage flags and number of cameras per store, day and visitor."""
    return not_staff(events).groupBy(*DAY, "visitor_id").agg(
        _flag("ENTRY").alias("has_entry"),
        _flag("ZONE_ENTER", "ZONE_DWELL").alias("has_engagement"),
        _flag("BILLING_QUEUE_JOIN").alias("has_billing"),
        _flag("PURCHASE").alias("has_purchase"),
        _flag("EXIT").alias("has_exit"),
        _flag("REENTRY").alias("has_reentry"),
        F.count_distinct("camera_id").alias("cam_count"),
    )


def visitor_journeys(stages: DataFrame) -> DataFrame:
    """A stage counts only when every earlier stage was reached."""
    engaged = F.col("has_entry") * F.col("has_engagement")
    billed = engaged * F.col("has_billing")
    return stages.select(
        *DAY, "visitor_id", "has_entry", engaged.alias("reached_engagement"), billed.alias("reached_billing"),
        (billed * F.col("has_purchase")).alias("reached_purchase"), "has_exit", "has_reentry", "cam_count",
    )


def journey_totals(journeys: DataFrame) -> DataFrame:
    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    return journeys.groupBy(*DAY).agg(
        F.count("*").alias("unique_visitors"),
        total("has_entry").alias("entry_count"),
        total("reached_engagement").alias("zone_engagement_count"),
        total("reached_billing").alias("billing_queue_count"),
        total("reached_purchase").alias("purchases_count"),
        total("has_exit").alias("exit_count"),
        total("has_reentry").alias("reentry_count"),
        F.count_if(F.col("cam_count") > 1).alias("cross_camera_visitors"),
    )


def store_day_funnel(events: DataFrame) -> DataFrame:
    return journey_totals(visitor_journeys(visitor_stages(events)))


def cross_camera_rate(totals: DataFrame) -> DataFrame:
    rate = F.col("cross_camera_visitors") / F.nullif(F.col("unique_visitors"), F.lit(0))
    return totals.select(*DAY, F.coalesce(rate, F.lit(0.0)).alias("cross_camera_match_rate"))


def hierarchy_check(totals: DataFrame) -> DataFrame:
    """Purchase <= billing <= engagement <= entry; the flag separates good rows from quarantine."""
    ok = (
        (F.col("purchases_count") <= F.col("billing_queue_count"))
        & (F.col("billing_queue_count") <= F.col("zone_engagement_count"))
        & (F.col("zone_engagement_count") <= F.col("entry_count"))
    )
    return totals.withColumn("hierarchy_ok", ok)


def assert_hierarchy(totals: DataFrame) -> DataFrame:
    """Fails the job on a violated hierarchy."""
    checked = hierarchy_check(totals)
    message = F.concat(F.lit("Funnel validation failed for "), F.col("store_id"))
    return checked.where(F.assert_true(F.col("hierarchy_ok"), message).isNull()).drop("hierarchy_ok")


def funnel_stages(totals: DataFrame) -> DataFrame:
    """Four rows per store and day: count and rate to the previous stage."""
    counts = ["entry_count", "zone_engagement_count", "billing_queue_count", "purchases_count"]
    rows = []
    for i, ((code, _), c) in enumerate(zip(FUNNEL_STAGES, counts)):
        if i == 0:
            rate = F.lit(1.0)
        else:
            prev = F.col(counts[i - 1])
            rate = F.when(prev > 0, F.round(F.col(c) / F.when(prev > 0, prev), 4)).otherwise(0.0)
        rows.append(
            F.struct(
                F.lit(i).alias("stage_order"), F.lit(code).alias("stage"), F.col(c).alias("count"), rate.alias("rate")
            )
        )
    return totals.select(*DAY, F.inline(F.array(*rows)))


def conversion_rate(purchases: Column, entries: Column) -> Column:
    raw = F.round(purchases / F.greatest(F.lit(1), entries), 4)
    return F.when(entries > 0, F.least(F.lit(1.0), raw)).otherwise(0.0)


def abandonment_visitors(events: DataFrame) -> DataFrame:
    abandoned = F.when(F.col("event_type") == "BILLING_QUEUE_ABANDON", F.col("visitor_id"))
    return not_staff(events).groupBy(*DAY).agg(F.count_distinct(abandoned).alias("abandonment_visitors"))


def zero_fill(totals: DataFrame, store_days: DataFrame) -> DataFrame:
    """Every requested store and day appears; missing counts are 0."""
    return store_days.join(totals, DAY, "left").fillna(0)


def store_day_spine(stores: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    return stores.select("store_id", F.explode(F.sequence(first_day, last_day)).alias("event_date"))


def summary_counts(events: DataFrame, dwell_seconds: Column) -> DataFrame:
    """Distinct customer sessions per stage, average dwell and purchases per queue join as text."""
    def sessions(kind: str) -> Column:
        return F.sum("f_" + kind).cast("long")

    kinds = ["ENTRY", "ZONE_DWELL", "PURCHASE", "BILLING_QUEUE_JOIN"]
    dwell = F.when(F.col("event_type") == "ZONE_DWELL", dwell_seconds).cast("decimal(38,16)")
    per_session = not_staff(events).groupBy(*DAY, "session_id").agg(
        *[_flag(k).alias("f_" + k) for k in kinds], F.sum(dwell).alias("d_sum"), F.count(dwell).alias("d_n")
    )
    out = per_session.groupBy(*DAY).agg(
        sessions("ENTRY").alias("visitors"), sessions("ZONE_DWELL").alias("engagement"),
        sessions("PURCHASE").alias("purchases"), sessions("BILLING_QUEUE_JOIN").alias("billing_joins"),
        F.coalesce(F.sum("d_sum").cast("double") / F.nullif(F.sum("d_n"), F.lit(0)), F.lit(0.0)).alias("avg_dwell_seconds"),
    )
    pct = F.format_string("%.1f%%", F.round(F.col("purchases") / F.col("billing_joins") * 100, 1))
    return out.withColumn("conversion_rate", F.when(F.col("billing_joins") > 0, pct).otherwise("0%"))
