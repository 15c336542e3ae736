"""Statistical anomalies on the hourly rollup, dead zones, suppression and display fields.

Windows run over the hourly rows of one store and hour of day, or over one store's alerts: both are
bounded by the calendar, whatever the number of events behind the rollup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.config import AnomalyConfig
from dwellgrid.fixed_values import RECOMMENDED_ACTIONS, TITLE_INACTIVE, TITLE_PLAIN, TITLE_SCORED, TREND_TEXT
from dwellgrid.functions.hashing import uuid5
from dwellgrid.functions.labels import fill, lookup, severity_class
from dwellgrid.functions.scoring import anomaly_confidence, seconds_between, severity, zscore

SIGNALS = (("QUEUE_SPIKE", "max_queue_depth", 1), ("CONVERSION_DROP", "conversion", -1), ("TRAFFIC_DROP", "unique_visitors", -1))


def current_hour_rows(hourly: DataFrame, as_of: Column) -> DataFrame:
    return hourly.where(F.col("hour_bucket") == F.date_trunc("hour", as_of))


def signals(hourly: DataFrame) -> DataFrame:
    """One row per store hour and watched metric."""
    ratio = F.col("conversions") / F.greatest(F.lit(1), F.col("unique_visitors"))
    value = {"conversion": ratio}
    items = [
        F.struct(
            F.lit(t).alias("anomaly_type"), F.lit(sign).alias("direction"),
            value.get(c, F.col(c)).cast("double").alias("metric_value"),
        )
        for t, c, sign in SIGNALS
    ]
    return hourly.select("store_id", "hour_bucket", F.inline(F.array(*items)))


def with_baseline(rows: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Count, mean and population deviation of the same hour of day over the lookback before each row."""
    w = (
        Window.partitionBy("store_id", "anomaly_type", F.hour("hour_bucket")).orderBy(F.unix_seconds("hour_bucket"))
        .rangeBetween(-cfg.lookback_days * 86400, -1)
    )
    x = F.col("metric_value")
    return rows.select(
        "*", F.count(x).over(w).alias("n"), F.avg(x).over(w).alias("baseline_value"), F.stddev_pop(x).over(w).alias("deviation")
    )


def with_zscore(rows: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    z = zscore(F.col("n"), F.col("baseline_value"), F.col("deviation"), F.col("metric_value"), cfg)
    return rows.withColumn("z", z)


def scored_signals(hourly: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    return with_zscore(with_baseline(signals(hourly), cfg), cfg)


def _anomaly_id(*parts: Column) -> Column:
    return uuid5(F.concat_ws("|", *parts))


def alerts(scored: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Rows whose z-score passes the threshold in the watched direction."""
    z = F.col("z")
    hits = scored.where(z * F.col("direction") > cfg.z_threshold)
    stamp = F.date_format("hour_bucket", "yyyy-MM-dd HH:mm:ss")
    return hits.select(
        _anomaly_id(F.col("store_id"), F.col("anomaly_type"), stamp).alias("anomaly_id"), "store_id",
        F.col("hour_bucket").alias("detected_at"), "anomaly_type", severity(z).alias("severity"),
        anomaly_confidence(z, F.col("n")).alias("confidence"), "metric_value", "baseline_value",
        F.round(z, 4).alias("z_score"), F.lit(None).cast("string").alias("affected_zone_id"),
        lookup(F.col("anomaly_type"), RECOMMENDED_ACTIONS).alias("recommended_action"),
    )


def suppress_repeats(found: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Drops alerts within the suppression time of the last kept alert of the same store and type.

    An alert further than that from the one before it is always kept, so the sequential rule only runs
    inside short runs of neighbouring hours.
    """
    key = ["store_id", "anomaly_type"]
    w = Window.partitionBy(*key).orderBy("detected_at")
    at = F.unix_seconds("detected_at")
    far = F.coalesce(at - F.lag(at).over(w) > cfg.suppress_seconds, F.lit(True))
    runs = found.withColumn("_far", far).withColumn("_run", F.sum(F.col("_far").cast("int")).over(w))
    rest = [c for c in found.columns if c not in key]
    packed = runs.groupBy(*key, "_run").agg(F.sort_array(F.collect_list(F.struct(at.alias("_at"), *rest))).alias("_rows"))
    times = F.transform("_rows", lambda r: r["_at"])
    start = F.array().cast("array<bigint>")
    kept = F.aggregate(
        times, start,
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.try_element_at(acc, F.lit(-1)) > cfg.suppress_seconds), F.array_append(acc, t)).otherwise(acc),
    )
    chosen = packed.withColumn("_kept", kept).withColumn("_rows", F.filter("_rows", lambda r: F.array_contains("_kept", r["_at"])))
    return chosen.select(*key, F.inline("_rows")).select(*found.columns)


def suppress_open(found: DataFrame, open_alerts: DataFrame, seconds: int) -> DataFrame:
    """Drops alerts for which an open alert of the same store, type and zone is recent enough.

    Only the open alerts' hours near each alert matter, so both sides meet on (key, time bucket)."""
    def bucket(ts: Column) -> Column:
        return F.floor(F.unix_seconds(ts) / seconds)

    recent = open_alerts.select(
        F.col("store_id").alias("o_store"), F.col("anomaly_type").alias("o_type"), F.col("affected_zone_id").alias("o_zone"),
        F.col("detected_at").alias("o_at"),
        F.explode(F.array(bucket(F.col("detected_at")), bucket(F.col("detected_at")) + 1)).alias("o_bucket"),
    )
    hour = F.date_trunc("hour", "detected_at")
    near = (
        (F.col("store_id") == F.col("o_store")) & (F.col("anomaly_type") == F.col("o_type"))
        & F.col("affected_zone_id").eqNullSafe(F.col("o_zone")) & (bucket(hour) == F.col("o_bucket"))
        & (seconds_between(hour, F.col("o_at")) <= seconds)
    )
    same_hour = (
        (F.col("store_id") == F.col("o_store")) & (F.col("anomaly_type") == F.col("o_type"))
        & F.col("affected_zone_id").eqNullSafe(F.col("o_zone")) & (F.col("o_at") > hour) & (hour == F.date_trunc("hour", "o_at"))
    )
    return found.join(recent, near, "left_anti").join(recent, same_hour, "left_anti")


def zone_visits(events: DataFrame) -> DataFrame:
    """Newest customer visit of every zone; the newest of several results is that of their events together."""
    return (
        events.where(~F.col("is_staff") & F.col("event_type").isin("ZONE_ENTER", "ZONE_DWELL"))
        .groupBy("store_id", "zone_id").agg(F.max("ts").alias("last_event_at"))
    )


def silent_zones(zones: DataFrame, seen: DataFrame, as_of: Column, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Display zones without a customer for the limit, by their newest visits; zones never visited count as 999 minutes."""
    watched = zones.where(~F.col("zone_type").isin("ENTRY", "BILLING")).select("store_id", "zone_id")
    lag = seconds_between(as_of, F.col("last_event_at")) / 60
    rows = watched.join(seen, ["store_id", "zone_id"], "left").withColumn("lag_minutes", F.coalesce(lag, F.lit(999.0)))
    return rows.where(F.col("last_event_at").isNull() | (F.col("lag_minutes") > cfg.dead_zone_minutes))


def dead_zones(zones: DataFrame, events: DataFrame, as_of: Column, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Display zones without a customer for the limit as of a time, from their events."""
    return silent_zones(zones, zone_visits(events), as_of, cfg)


def dead_zone_alerts(silent: DataFrame, as_of: Column, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    kind = F.lit("DEAD_ZONE")
    stamp = F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")
    return silent.select(
        _anomaly_id(F.col("store_id"), kind, F.col("zone_id"), stamp).alias("anomaly_id"), "store_id",
        as_of.alias("detected_at"), kind.alias("anomaly_type"), F.lit("WARN").alias("severity"), F.lit(0.9).alias("confidence"),
        F.round("lag_minutes", 1).alias("metric_value"), F.lit(float(cfg.dead_zone_minutes)).alias("baseline_value"),
        F.lit(0.0).alias("z_score"), F.col("zone_id").alias("affected_zone_id"),
        F.lit(RECOMMENDED_ACTIONS["DEAD_ZONE"]).alias("recommended_action"),
    )


def active_anomalies(anomalies: DataFrame) -> DataFrame:
    """Unresolved alerts with the number of active ones of the store; sort by ``detected_at`` to show them."""
    w = Window.partitionBy("store_id")
    return anomalies.where(~F.col("is_resolved")).withColumn("active_count", F.count("*").over(w))


def with_store_context(anomalies: DataFrame, hourly: DataFrame) -> DataFrame:
    """Adds the conversion rate of the store's newest hourly row."""
    latest = hourly.groupBy("store_id").agg(
        F.max_by(F.struct("conversions", "unique_visitors"), "hour_bucket").alias("h")
    )
    rate = F.when(F.col("h.unique_visitors") > 0, F.col("h.conversions") / F.nullif(F.col("h.unique_visitors"), F.lit(0)))
    return anomalies.join(latest, "store_id", "left").withColumn("conversion_rate", rate).drop("h")


def trend_percent(metric: Column, baseline: Column) -> Column:
    return (metric - baseline) / F.greatest(F.abs(baseline), F.lit(1e-6)) * 100


def trend_summary(anomalies: DataFrame) -> DataFrame:
    delta = trend_percent(F.col("metric_value"), F.col("baseline_value"))
    way = F.when(delta > 0, "above").otherwise("below")
    text = fill(TREND_TEXT, {
        "delta": F.format_string("%.0f", F.round(F.abs(delta), 0)), "direction": way,
        "z": F.format_string("%.2f", F.round("z_score", 2)),
    })
    return anomalies.withColumn("delta_pct", F.round(delta, 4)).withColumn("direction", way).withColumn("trend_summary", text)


def counts_by_severity(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("store_id", severity_class(F.col("severity")).alias("severity_class")).agg(F.count("*").alias("anomalies"))


def counts_by_zone(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("store_id", F.coalesce("affected_zone_id", F.lit("Other")).alias("zone")).agg(F.count("*").alias("anomalies"))


def anomaly_title() -> Column:
    label = F.replace(F.col("anomaly_type"), F.lit("_"), F.lit(" "))
    zone = F.when(F.col("affected_zone_id").isNotNull(), F.concat(F.lit(" · "), "affected_zone_id")).otherwise("")
    parts = {
        "label": label, "zone": zone, "minutes": F.format_string("%.0f", F.round("metric_value", 0)),
        "z": F.format_string("%.1f", F.round("z_score", 1)),
        "percent": F.format_string("%.0f", F.round(F.col("confidence") * 100, 0)),
    }
    return (
        F.when(F.col("anomaly_type") == "DEAD_ZONE", fill(TITLE_INACTIVE, parts))
        .when(F.col("z_score") == 0, fill(TITLE_PLAIN, parts)).otherwise(fill(TITLE_SCORED, parts))
    )
