"""Zone heatmap per store and day, scores, tiers and rankings.

Windows in this module run over the zones of one store and day, or over the days of one zone; both
are bounded by the floor plan and the calendar, not by the number of events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.config import HeatmapConfig
from dwellgrid.functions.labels import score_tier
from dwellgrid.functions.scoring import exact_avg, seconds_between
from dwellgrid.operators.funnel import DAY, not_staff
from dwellgrid.operators.rollups import event_dwell

ZONE_DAY = [*DAY, "zone_id"]


def _in_zone(events: DataFrame) -> DataFrame:
    return not_staff(events).where(F.col("zone_id").isNotNull())


def zone_visitors(events: DataFrame) -> DataFrame:
    return _in_zone(events).groupBy(*ZONE_DAY).agg(F.count_distinct("session_id").alias("visitor_count"))


def zone_avg_dwell(events: DataFrame) -> DataFrame:
    dwell = event_dwell(events)
    rows = _in_zone(events).where(F.col("event_type") == "ZONE_DWELL")
    return rows.groupBy(*ZONE_DAY).agg(exact_avg(dwell).alias("avg_dwell"))


def zone_dwell_fallback(events: DataFrame) -> DataFrame:
    """First entry into a zone until the session's last exit or purchase, averaged by zone and day."""
    enters = (
        events.where((F.col("event_type") == "ZONE_ENTER") & F.col("zone_id").isNotNull())
        .groupBy(*ZONE_DAY, "session_id").agg(F.min("ts").alias("enter_ts"))
    )
    leaves = events.where(F.col("event_type").isin("ZONE_EXIT", "EXIT", "PURCHASE")).groupBy("session_id").agg(
        F.max("ts").alias("leave_ts")
    )
    spans = enters.join(leaves, "session_id").where(F.col("leave_ts") > F.col("enter_ts"))
    return spans.groupBy(*ZONE_DAY).agg(
        exact_avg(seconds_between(F.col("leave_ts"), F.col("enter_ts"))).alias("fallback_dwell")
    )


def zone_enter_exit(events: DataFrame) -> DataFrame:
    return _in_zone(events).groupBy(*ZONE_DAY).agg(
        F.count_if(F.col("event_type") == "ZONE_ENTER").alias("zone_enter_count"),
        F.count_if(F.col("event_type") == "ZONE_EXIT").alias("zone_exit_count"),
    )


def data_confidence(events: DataFrame, cfg: HeatmapConfig = HeatmapConfig()) -> DataFrame:
    return not_staff(events).groupBy(*DAY).agg(F.count_distinct("session_id").alias("sessions")).withColumn(
        "data_confidence", F.col("sessions") >= cfg.min_sessions
    )


def zone_heatmap(zones: DataFrame, events: DataFrame) -> DataFrame:
    """All zones of a store on every day with events; dwell falls back to session spans, then to 0."""
    spine = zones.select("store_id", "zone_id", "zone_name", "zone_type").join(
        events.select(*DAY).distinct(), "store_id"
    )
    joined = spine
    for part in (zone_visitors(events), zone_avg_dwell(events), zone_dwell_fallback(events), zone_enter_exit(events)):
        joined = joined.join(part, ZONE_DAY, "left")
    live = F.nullif(F.col("avg_dwell"), F.lit(0.0))
    dwell = F.coalesce(live, F.col("fallback_dwell"), F.lit(0.0))
    source = F.when(live.isNotNull(), "live_dwell").when(F.col("fallback_dwell").isNotNull(), "fallback").otherwise("none")
    w = Window.partitionBy(*DAY)
    top = F.greatest(F.max("avg_dwell").over(w), F.max("fallback_dwell").over(w))
    top = F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0))
    shown = joined.withColumn("dwell", dwell).withColumn("source", source).withColumn("top", top)
    return shown.select(
        *DAY, "zone_id", "zone_name", "zone_type", F.round("dwell", 1).alias("avg_dwell_seconds"),
        F.coalesce("visitor_count", F.lit(0)).alias("visitor_count"),
        F.coalesce("zone_enter_count", F.lit(0)).alias("zone_enter_count"),
        F.coalesce("zone_exit_count", F.lit(0)).alias("zone_exit_count"),
        F.round(F.col("dwell") / F.col("top"), 4).alias("intensity"), F.col("source").alias("data_source"),
    )


def zone_score(avg_dwell: Column, visitors: Column, cfg: HeatmapConfig = HeatmapConfig()) -> Column:
    raw = F.round(avg_dwell / cfg.dwell_scale * 50 + visitors / cfg.visitor_scale * 50).cast("int")
    capped = F.least(F.lit(100), raw)
    return F.when(capped == 0, 50).otherwise(capped)


def with_scores(heatmap: DataFrame) -> DataFrame:
    scored = heatmap.withColumn("score", zone_score(F.col("avg_dwell_seconds"), F.col("visitor_count")))
    return scored.withColumn("tier", score_tier(F.col("score")))


def zone_rank(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy(*DAY).orderBy(F.desc("score"), "zone_id")
    return scored.withColumn("rank", F.row_number().over(w))


def top_bottom(scored: DataFrame, k: int = 3) -> DataFrame:
    """The k best and the k worst zones of each store and day."""
    best = Window.partitionBy(*DAY).orderBy(F.desc("score"), "zone_id")
    worst = Window.partitionBy(*DAY).orderBy("score", F.desc("zone_id"))
    ranked = scored.withColumn("from_top", F.row_number().over(best)).withColumn("from_bottom", F.row_number().over(worst))
    return ranked.where((F.col("from_top") <= k) | (F.col("from_bottom") <= k))


def filter_zones(scored: DataFrame, tier: str = "all", zone_id: str = "all") -> DataFrame:
    out = scored if tier == "all" else scored.where(F.col("tier") == tier)
    return out if zone_id == "all" else out.where(F.col("zone_id") == zone_id)


def zone_performance(events: DataFrame) -> DataFrame:
    """Visitors, conversion (%) and change of visitors (%) against the zone's previous day with visits."""
    sales = not_staff(events).where(F.col("event_type") == "PURCHASE").select("session_id").distinct().withColumn("sold", F.lit(1))
    visits = _in_zone(events).select(*ZONE_DAY, "session_id").distinct()
    daily = visits.join(sales, "session_id", "left").groupBy(*ZONE_DAY).agg(
        F.count("*").alias("visitors"), F.count("sold").alias("buyers")
    )
    prev = F.lag("visitors").over(Window.partitionBy("store_id", "zone_id").orderBy("event_date"))
    trend = F.coalesce((F.col("visitors") - prev) / F.greatest(F.lit(1), prev) * 100, F.lit(0.0))
    return daily.select(
        *ZONE_DAY, "visitors", (F.col("buyers") / F.col("visitors") * 100).alias("conversion_rate"), trend.alias("trend")
    )


def zone_panel(performance: DataFrame, low_rate: float = 15.0, low_min_visitors: int = 100) -> DataFrame:
    low = (F.col("conversion_rate") < low_rate) & (F.col("visitors") > low_min_visitors)
    weighted = F.sum(F.col("conversion_rate") * F.col("visitors")) / F.greatest(F.lit(1), F.sum("visitors"))
    return performance.groupBy(*DAY).agg(
        F.round(weighted, 4).alias("weighted_conversion"),
        F.round(F.avg("trend"), 4).alias("avg_trend"),
        F.min_by("zone_id", F.struct(-F.col("trend"), F.col("zone_id"))).alias("biggest_gain_zone"),
        F.min_by("zone_id", F.struct(F.col("trend"), F.col("zone_id"))).alias("biggest_drop_zone"),
        F.count_if(low).alias("low_converters"),
    )


def minmax_scale(heatmap: DataFrame) -> DataFrame:
    """Dwell scaled to the store's range of the day, where the range always contains 0 and 1."""
    w = Window.partitionBy(*DAY)
    v = F.col("avg_dwell_seconds")
    low = F.least(F.min(v).over(w), F.lit(0.0))
    high = F.greatest(F.max(v).over(w), F.lit(1.0))
    return heatmap.withColumn("scaled", (v - low) / F.greatest(F.lit(1.0), high - low))


def best_worst_zone(events: DataFrame) -> DataFrame:
    """Zones with most and fewest dwell sessions; ties go to the first zone id."""
    dwelled = _in_zone(events).where(F.col("event_type") == "ZONE_DWELL")
    counts = dwelled.groupBy(*ZONE_DAY).agg(F.count_distinct("session_id").alias("n"))
    return counts.groupBy(*DAY).agg(
        F.min_by("zone_id", F.struct(-F.col("n"), F.col("zone_id"))).alias("top_zone"),
        F.min_by("zone_id", F.struct(F.col("n"), F.col("zone_id"))).alias("worst_zone"),
    )
