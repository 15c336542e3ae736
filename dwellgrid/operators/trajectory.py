"""Sightings to behavioural events: entries, re-entries, zone changes, dwell, exits, sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.config import HeatmapConfig, ReidConfig
from dwellgrid.fixed_values import GENERATOR_EVENT_TYPES
from dwellgrid.functions.scoring import seconds_between
from dwellgrid.operators.ordered import OrderedRows
from dwellgrid.session import broadcast_if_small

VISITOR = ["store_id", "visitor_id"]


def _visitor_rows(sightings: DataFrame, *columns: str) -> OrderedRows:
    return OrderedRows.of(sightings.select(*VISITOR, "ts", "event_id", *columns), VISITOR, ["ts", "event_id"])


def entry_events(sightings: DataFrame) -> DataFrame:
    """First sighting of each visitor in a store."""
    first = sightings.groupBy(*VISITOR).agg(
        F.min_by(F.struct("ts", "event_id", "camera_id"), F.struct("ts", "event_id")).alias("s")
    )
    return first.select(*VISITOR, F.lit("ENTRY").alias("event_type"), "s.ts", "s.event_id", "s.camera_id")


def reentry_flag(cfg: ReidConfig) -> Column:
    gap = seconds_between(F.col("ts"), F.col("prev_ts"))
    return F.coalesce(gap.between(cfg.reentry_min_seconds, cfg.window_seconds), F.lit(False))


def reentry_events(sightings: DataFrame, cfg: ReidConfig = ReidConfig()) -> DataFrame:
    rows = _visitor_rows(sightings).lag({"prev_ts": "ts"}).result()
    return rows.where(reentry_flag(cfg)).select(
        *VISITOR, F.lit("REENTRY").alias("event_type"), "ts", "event_id",
        seconds_between(F.col("ts"), F.col("prev_ts")).alias("gap_seconds"),
    )


def session_sequence(sightings: DataFrame, cfg: ReidConfig = ReidConfig()) -> DataFrame:
    """Visit number (0 first) and 1-based event number within the visit."""
    rows = _visitor_rows(sightings).lag({"prev_ts": "ts"})
    again = reentry_flag(cfg)
    rows = rows.running_sum("visit_no", F.when(again, 1).otherwise(0)).row_number("n")
    starts = F.when(again | F.col("prev_ts").isNull(), F.col("n"))
    rows = rows.last_value("start_n", starts)
    return rows.result().select(
        *VISITOR, "ts", "event_id", F.col("visit_no").cast("long").alias("visit_no"),
        (F.col("n") - F.col("start_n") + 1).alias("sequence_number"),
    )


def _zone_changes(sightings: DataFrame) -> OrderedRows:
    """Sightings in a zone other than the previous one (nulls count as a zone of their own)."""
    rows = _visitor_rows(sightings, "zone_id").lag({"prev_zone": "zone_id"})
    return rows.where(~F.col("zone_id").eqNullSafe(F.col("prev_zone")))


def zone_transitions(sightings: DataFrame) -> DataFrame:
    """ZONE_EXIT of the left zone and ZONE_ENTER of the new one at every change."""
    out = F.when(F.col("prev_zone").isNotNull(), F.struct(F.lit("ZONE_EXIT").alias("event_type"), F.col("prev_zone").alias("zone_id")))
    into = F.when(F.col("zone_id").isNotNull(), F.struct(F.lit("ZONE_ENTER").alias("event_type"), F.col("zone_id").alias("zone_id")))
    return _zone_changes(sightings).result().select(
        *VISITOR, "ts", "event_id", F.inline(F.array_compact(F.array(out, into)))
    )


def zone_dwell_on_exit(sightings: DataFrame, cfg: HeatmapConfig = HeatmapConfig()) -> DataFrame:
    """ZONE_DWELL when a visitor leaves a zone after more than the minimum time."""
    stays = _zone_changes(sightings).lead({"exit_ts": "ts"}).result().where(
        F.col("zone_id").isNotNull() & F.col("exit_ts").isNotNull()
    )
    dwell = seconds_between(F.col("exit_ts"), F.col("ts"))
    return stays.where(dwell > cfg.min_zone_dwell_seconds).select(
        *VISITOR, "zone_id", F.col("ts").alias("enter_ts"), "exit_ts", dwell.alias("dwell_seconds")
    )


def exit_at_feed_end(sightings: DataFrame) -> DataFrame:
    """EXIT at the end of the store's feed for every visitor whose last event is not an exit."""
    ends = sightings.groupBy("store_id").agg(F.max("ts").alias("ts"))
    last = sightings.groupBy(*VISITOR).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    active = last.where(F.col("last_type") != "EXIT")
    return active.join(broadcast_if_small(ends), "store_id").select(
        *VISITOR, F.lit("EXIT").alias("event_type"), "ts", F.lit(0.8).alias("confidence"), F.lit("video_end").alias("reason")
    )


def purchase_on_billing_exit(sightings: DataFrame, zones: DataFrame, strict_types: bool = True) -> DataFrame:
    """PURCHASE whenever a visitor leaves a billing zone; strict types drop it, as the generator does."""
    billing = zones.where(F.col("zone_type") == "BILLING").select("store_id", "zone_id")
    left_zone = zone_transitions(sightings).where(F.col("event_type") == "ZONE_EXIT")
    sales = left_zone.join(broadcast_if_small(billing), ["store_id", "zone_id"]).withColumn("event_type", F.lit("PURCHASE"))
    return sales.where(F.col("event_type").isin(*GENERATOR_EVENT_TYPES)) if strict_types else sales
