"""Event-stream KPIs per store and day; staff events are included by design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.scoring import exact_avg
from dwellgrid.operators.funnel import DAY
from dwellgrid.operators.ordered import OrderedRows
from dwellgrid.operators.rollups import event_dwell

DEFAULT_CONFIDENCE = 0.94


def _count(*types: str) -> Column:
    return F.count_if(F.col("event_type").isin(*types))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / F.when(whole > 0, whole) * 100, 1)).otherwise(0.0)


def entrance_stats(events: DataFrame) -> DataFrame:
    out = events.groupBy(*DAY).agg(
        _count("ENTRY").alias("entry_count"), _count("EXIT").alias("exit_count"), _count("REENTRY").alias("reentry_count")
    )
    occupancy = F.col("entry_count") + F.col("reentry_count") - F.col("exit_count")
    return out.withColumn("current_occupancy", F.greatest(F.lit(0).cast("long"), occupancy))


def zone_stats(events: DataFrame) -> DataFrame:
    dwell = F.when(F.col("event_type") == "ZONE_DWELL", event_dwell(events))
    return events.groupBy(*DAY).agg(
        _count("ZONE_ENTER").alias("zone_enter_count"), _count("ZONE_EXIT").alias("zone_exit_count"),
        _count("ZONE_DWELL").alias("zone_dwell_count"),
        F.coalesce(exact_avg(dwell), F.lit(0.0)).alias("avg_dwell_seconds"),
    )


def billing_stats(events: DataFrame) -> DataFrame:
    """Distinct visitors per billing step: flags per visitor first, then sums (one shuffle key, no row expansion)."""
    def flag(t: str) -> Column:
        return F.max(F.when(F.col("event_type") == t, 1).otherwise(0))

    per_visitor = events.groupBy(*DAY, "visitor_id").agg(
        flag("BILLING_QUEUE_JOIN").alias("j"), flag("BILLING_QUEUE_ABANDON").alias("a"), flag("PURCHASE").alias("p")
    )
    out = per_visitor.groupBy(*DAY).agg(
        F.sum("j").alias("queue_join_count"), F.sum("a").alias("queue_abandon_count"), F.sum("p").alias("purchase_count")
    )
    joins = F.col("queue_join_count")
    return out.withColumn("queue_abandon_rate", _percent(F.col("queue_abandon_count"), joins)).withColumn(
        "billing_conversion_rate", _percent(F.col("purchase_count"), joins)
    )


def reid_stats_day(events: DataFrame) -> DataFrame:
    """Visitors seen by more than one camera, match rate and fragmented remainder."""
    seen = events.select(*DAY, "visitor_id", "camera_id").distinct()
    per_visitor = seen.groupBy(*DAY, "visitor_id").agg((F.count("camera_id") > 1).alias("multi"))
    out = per_visitor.groupBy(*DAY).agg(
        F.count("*").alias("total_visitors"), F.count_if("multi").alias("cross_camera_matches")
    )
    return out.select(
        "*", _percent(F.col("cross_camera_matches"), F.col("total_visitors")).alias("match_rate"),
        (F.col("total_visitors") - F.col("cross_camera_matches")).alias("fragmented_visitors"),
    )


def avg_confidence(events: DataFrame) -> DataFrame:
    mean = F.coalesce(exact_avg(F.col("confidence")), F.lit(DEFAULT_CONFIDENCE))
    return events.groupBy(*DAY).agg(F.round(mean * 100, 1).alias("avg_confidence"))


def event_stream_report(events: DataFrame) -> DataFrame:
    """Entrance, zone, billing and identity blocks nested in one row per store and day.

    One scan: counts per visitor and camera are folded per visitor and then per day, so distinct
    visitors and cameras need no row expansion."""
    kinds = {
        "ENTRY": "entry", "EXIT": "exit", "REENTRY": "reentry", "ZONE_ENTER": "zone_enter", "ZONE_EXIT": "zone_exit",
        "ZONE_DWELL": "zone_dwell", "BILLING_QUEUE_JOIN": "queue_join", "BILLING_QUEUE_ABANDON": "queue_abandon",
        "PURCHASE": "purchase",
    }
    dwell = F.when(F.col("event_type") == "ZONE_DWELL", event_dwell(events)).cast("decimal(38,16)")
    conf = F.col("confidence").cast("decimal(38,16)")
    sums = [*kinds.values(), "dwell_sum", "dwell_n", "conf_sum", "conf_n"]
    per_camera = events.groupBy(*DAY, "visitor_id", "camera_id").agg(
        *[_count(k).alias(v) for k, v in kinds.items()],
        F.sum(dwell).alias("dwell_sum"), F.count(dwell).alias("dwell_n"), F.sum(conf).alias("conf_sum"), F.count(conf).alias("conf_n"),
    )
    per_visitor = per_camera.groupBy(*DAY, "visitor_id").agg(
        *[F.sum(c).alias(c) for c in sums], (F.count("camera_id") > 1).alias("multi")
    )
    per_day = per_visitor.groupBy(*DAY).agg(
        *[F.sum(c).alias(c) for c in sums], F.count("*").alias("total"), F.count_if("multi").alias("matched"),
        *[F.count_if(F.col(c) > 0).alias("v_" + c) for c in ("queue_join", "queue_abandon", "purchase")],
    )

    def mean(part: str) -> Column:
        return F.col(part + "_sum").cast("double") / F.nullif(F.col(part + "_n"), F.lit(0))

    inside = F.col("entry") + F.col("reentry") - F.col("exit")
    joins = F.col("v_queue_join")
    return per_day.select(
        *DAY,
        F.struct(
            F.col("entry").alias("entry_count"), F.col("exit").alias("exit_count"), F.col("reentry").alias("reentry_count"),
            F.greatest(F.lit(0).cast("long"), inside).alias("current_occupancy"),
        ).alias("entrance"),
        F.struct(
            F.col("zone_enter").alias("zone_enter_count"), F.col("zone_exit").alias("zone_exit_count"),
            F.col("zone_dwell").alias("zone_dwell_count"), F.coalesce(mean("dwell"), F.lit(0.0)).alias("avg_dwell_seconds"),
        ).alias("zone"),
        F.struct(
            joins.alias("queue_join_count"), F.col("v_queue_abandon").alias("queue_abandon_count"),
            F.col("v_purchase").alias("purchase_count"),
            _percent(F.col("v_queue_abandon"), joins).alias("queue_abandon_rate"),
            _percent(F.col("v_purchase"), joins).alias("billing_conversion_rate"),
        ).alias("billing"),
        F.struct(
            F.col("total").alias("total_visitors"), F.col("matched").alias("cross_camera_matches"),
            _percent(F.col("matched"), F.col("total")).alias("match_rate"),
            (F.col("total") - F.col("matched")).alias("fragmented_visitors"),
            F.round(F.coalesce(mean("conf"), F.lit(DEFAULT_CONFIDENCE)) * 100, 1).alias("avg_confidence"),
        ).alias("reid"),
    )


def occupancy_timeline(events: DataFrame) -> DataFrame:
    """Running occupancy per store after every entry, re-entry and exit."""
    step = F.when(F.col("event_type") == "EXIT", -1).otherwise(1)
    moves = events.where(F.col("event_type").isin("ENTRY", "REENTRY", "EXIT")).select("store_id", "ts", "event_id", step.alias("step"))
    rows = OrderedRows.of(moves, ["store_id"], ["ts", "event_id"]).running_sum("balance", F.col("step")).result()
    return rows.select(
        "store_id", "ts", "event_id", F.greatest(F.lit(0), F.col("balance")).cast("long").alias("occupancy")
    )
