"""Feed freshness per store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.config import HealthConfig
from dwellgrid.functions.scoring import seconds_between


def feed_freshness(stores: DataFrame, events: DataFrame, as_of: Column, cfg: HealthConfig = HealthConfig()) -> DataFrame:
    last = events.groupBy("store_id").agg(F.max("ts").alias("last_event_at"))
    lag = seconds_between(as_of, F.col("last_event_at"))
    return stores.select("store_id").join(last, "store_id", "left").select(
        "store_id", "last_event_at", F.round(lag, 1).alias("lag_seconds"),
        F.coalesce(lag > cfg.stale_seconds, F.lit(True)).alias("stale_feed"),
    )


def feed_status(freshness: DataFrame) -> DataFrame:
    """One row: overall status and how many of the stores are stale."""
    return freshness.agg(
        F.when(F.bool_or("stale_feed"), "degraded").otherwise("healthy").alias("status"),
        F.count_if("stale_feed").alias("stale_stores"), F.count("*").alias("stores"),
    )


def stale_stores(freshness: DataFrame) -> DataFrame:
    return freshness.where("stale_feed")


def lag_progress(lag_seconds: Column, cfg: HealthConfig = HealthConfig()) -> Column:
    lag = F.coalesce(lag_seconds, F.lit(cfg.stale_seconds))
    return F.least(F.lit(100.0), lag / cfg.stale_seconds * 100)
