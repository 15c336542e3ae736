"""Streaming forms that run the batch operators on every micro-batch: anomalies, late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.config import AnomalyConfig
from dwellgrid.operators import anomaly, rollups, sessions
from dwellgrid.session import cut_lineage
from dwellgrid.sources import readers
from dwellgrid.sources.writers import overwrite_partitions
from dwellgrid.streaming.jobs import batch_path

Handler = Callable[[DataFrame, int], None]


def _newest_before(spark: SparkSession, root: str, batch_id: int) -> Column:
    """Newest event time of all earlier batches, carried in the progress of the last one; null before the first."""
    if batch_id == 0:
        return F.lit(None).cast("timestamp")
    return spark.read.schema("newest timestamp").parquet(batch_path(f"{root}/progress", batch_id - 1)).agg(F.max("newest")).scalar()


def _keep_newest(batch: DataFrame, root: str, batch_id: int) -> None:
    before = _newest_before(batch.sparkSession, root, batch_id)
    newest = batch.agg(F.max("ts").alias("newest")).select(F.greatest("newest", before).alias("newest"))
    newest.write.mode("overwrite").parquet(batch_path(f"{root}/progress", batch_id))


def wire_handler(root: str) -> Handler:
    """Good events of each batch of lines go to ``root/events``, all others with their text to ``root/quarantine``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = cut_lineage(readers.checked_lines(batch))
        readers.good_events(checked).write.mode("overwrite").parquet(batch_path(f"{root}/events", batch_id))
        readers.quarantined(checked).write.mode("overwrite").parquet(batch_path(f"{root}/quarantine", batch_id))

    return handle


def _keep_unrepeated(touched: DataFrame, alerts: DataFrame, root: str, batch_id: int, cfg: AnomalyConfig) -> None:
    """Rewrites ``root/kept``, the alerts left by the suppression of repeats, from the first touched day on.

    Whether an alert is kept depends on earlier ones only: kept alerts before that day stay, and those within the
    suppression time of it stand for all that came before."""
    spark, first = touched.sparkSession, touched.agg(F.min("event_date")).scalar()
    stored = alerts.where(F.col("event_date") >= first)
    found = stored.where(F.col("anomaly_id").isNotNull())
    if batch_id > 0:
        reach = F.date_sub(first, -(-cfg.suppress_seconds // 86400))
        before = spark.read.schema(alerts.schema).parquet(f"{root}/kept").where(F.col("anomaly_id").isNotNull())
        found = found.unionByName(before.where((F.col("event_date") < first) & (F.col("event_date") >= reach)))
    kept = anomaly.suppress_repeats(found, cfg).where(F.col("event_date") >= first)
    days = stored.select("event_date").distinct()
    overwrite_partitions(cut_lineage(kept.unionByName(days, allowMissingColumns=True)), f"{root}/kept", "event_date")


def _add_dead_zones(batch: DataFrame, zones: DataFrame, as_of: Column, root: str, batch_id: int, cfg: AnomalyConfig) -> None:
    """Adds the dead zones as of the newest time to ``root/dead``, unless a stored alert has the id or is still open.

    ``root/visits`` carries the newest visit of every zone. Alerts have a folder per batch and are compared with those of
    earlier batches only, so a repeated batch writes the same."""
    spark, seen = batch.sparkSession, anomaly.zone_visits(batch)
    if batch_id > 0:
        carried = spark.read.schema(seen.schema).parquet(batch_path(f"{root}/visits", batch_id - 1))
        seen = seen.unionByName(carried).groupBy("store_id", "zone_id").agg(F.max("last_event_at").alias("last_event_at"))
    seen.write.mode("overwrite").parquet(batch_path(f"{root}/visits", batch_id))
    seen = spark.read.schema(seen.schema).parquet(batch_path(f"{root}/visits", batch_id))
    now = anomaly.dead_zone_alerts(anomaly.silent_zones(zones, seen, as_of, cfg), as_of, cfg).where(F.col("detected_at").isNotNull())
    if batch_id > 0:
        stored = spark.read.schema(now.schema).parquet(f"{root}/dead").where(F.col("batch") < batch_id).drop("batch")
        recent = stored.where(F.col("detected_at") >= F.date_trunc("hour", as_of) - F.expr(f"interval {cfg.dead_zone_suppress_seconds} seconds"))
        now = anomaly.suppress_open(now, recent, cfg.dead_zone_suppress_seconds).join(stored, "anomaly_id", "left_anti")
    now.write.mode("overwrite").parquet(batch_path(f"{root}/dead", batch_id))


def anomaly_handler(
    root: str, transactions_of: Callable[[DataFrame], DataFrame], cfg: AnomalyConfig = AnomalyConfig(),
    zones: DataFrame | None = None,
) -> Handler:
    """Appends events, recomputes the touched days of the rollup and every alert that they can change, suppresses repeats
    and, for the given zones, adds the dead ones as of the newest time so far.

    An hour changes its own alerts and, as part of their baseline, those of the same hour on the following lookback days.
    Hourly rows and alerts are tables by day; a batch reads and rewrites the touched days and those after them within the
    lookback, so its work does not depend on the history, alerts of half-filled hours are taken back when the hour fills,
    and a repeated batch writes the same. Dead zones are what was known at the end of a batch and are not taken back.
    ``current_anomalies`` reads the result, ``current_alerts`` the scored alerts before suppression."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(
            "event_id", "store_id", "session_id", "visitor_id", "event_type", "ts", "event_date", "zone_id", "is_staff",
            "metadata_json", "value", "k",
        )
        rows.write.mode("overwrite").partitionBy("event_date").parquet(batch_path(f"{root}/events", batch_id))
        _keep_newest(batch, root, batch_id)
        touched = cut_lineage(rollups.affected_buckets(batch).select("event_date").distinct())
        base = spark.read.schema(rows.schema).parquet(f"{root}/events").join(touched, "event_date", "left_semi")
        as_of = spark.read.schema("newest timestamp").parquet(batch_path(f"{root}/progress", batch_id)).agg(F.max("newest")).scalar()
        fresh = rollups.hourly_metrics(base, sessions.session_fold(base), transactions_of(base), as_of).drop("zone_dwell")
        fresh = cut_lineage(fresh.withColumn("event_date", F.to_date("hour_bucket")))
        overwrite_partitions(fresh, f"{root}/hourly", "event_date")

        def within(first: int, last: int) -> DataFrame:
            steps = F.sequence(F.lit(first), F.lit(last))
            return touched.select(F.explode(F.transform(steps, lambda n: F.date_add("event_date", n))).alias("event_date")).distinct()

        days = cut_lineage(within(0, cfg.lookback_days))
        hourly = spark.read.schema(fresh.schema).parquet(f"{root}/hourly")
        near = hourly.join(within(-cfg.lookback_days, cfg.lookback_days), "event_date", "left_semi")
        found = anomaly.alerts(anomaly.scored_signals(near, cfg), cfg).withColumn("event_date", F.to_date("detected_at"))
        found = found.join(days, "event_date", "left_semi")
        # a day without alerts gets a row without id, so that its earlier alerts are overwritten
        overwrite_partitions(cut_lineage(found.unionByName(days, allowMissingColumns=True)), f"{root}/alerts", "event_date")
        _keep_unrepeated(touched, spark.read.schema(found.schema).parquet(f"{root}/alerts"), root, batch_id, cfg)
        if zones is not None:
            _add_dead_zones(rows, zones, as_of, root, batch_id, cfg)

    return handle


def current_alerts(spark: SparkSession, root: str) -> DataFrame:
    """Every scored alert, repeats included."""
    return spark.read.parquet(f"{root}/alerts").where(F.col("anomaly_id").isNotNull()).drop("event_date")


def current_anomalies(spark: SparkSession, root: str) -> DataFrame:
    """Scored alerts without suppressed repeats, and the dead zones; needs a handler with zones."""
    kept = spark.read.parquet(f"{root}/kept").where(F.col("anomaly_id").isNotNull()).drop("event_date")
    return kept.unionByName(spark.read.schema(kept.schema).parquet(f"{root}/dead").drop("batch"))


def late_handler(root: str, delay_seconds: int = 7200) -> Handler:
    """Sends rows older than the watermark of the earlier batches to the repair path, the rest to the table."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        _keep_newest(batch, root, batch_id)
        limit = _newest_before(batch.sparkSession, root, batch_id) - F.expr(f"interval {delay_seconds} seconds")
        late = F.coalesce(F.col("ts") < limit, F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(batch_path(f"{root}/table", batch_id))
        batch.where(late).write.mode("overwrite").parquet(batch_path(f"{root}/late", batch_id))

    return handle


def repair_buckets(late_rows: DataFrame) -> DataFrame:
    """Store hours that late rows re-open."""
    return rollups.affected_buckets(late_rows)
