"""Validation, deduplication and enrichment of raw events and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.config import BatchConfig, DetectionConfig
from dwellgrid.fixed_values import EVENT_TYPES, GENERATOR_EVENT_TYPES
from dwellgrid.functions.geometry import box_area
from dwellgrid.functions.hashing import semantic_key


def check_event_type(events: DataFrame, allowed: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    return events.withColumn("type_ok", F.coalesce(F.col("event_type").isin(*allowed), F.lit(False)))


def check_both_type_sets(events: DataFrame) -> DataFrame:
    return check_event_type(events).withColumn("generator_type_ok", F.col("event_type").isin(*GENERATOR_EVENT_TYPES))


def parse_utc(text: Column) -> Column:
    """ISO text with offset, or naive text taken as UTC; null when unreadable."""
    return F.try_to_timestamp(text)


def field_errors(cfg: BatchConfig = BatchConfig()) -> Column:
    """Names of the fields that break a rule (empty when the row is good)."""
    def length_bad(c: str, limit: int) -> Column:
        n = F.length(c)
        return F.coalesce((n < 1) | (n > limit), F.lit(True))

    rules = {
        "store_id": length_bad("store_id", cfg.max_store_id),
        "visitor_id": length_bad("visitor_id", cfg.max_visitor_id),
        "camera_id": F.col("camera_id").isNull(),
        "confidence": ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)),
        "timestamp": parse_utc(F.col("timestamp")).isNull(),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))


def validate_fields(raw: DataFrame) -> DataFrame:
    return raw.withColumn("errors", field_errors())


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine with reasons)."""
    checked = check_event_type(raw).withColumn("errors", field_errors())
    good = (F.size("errors") == 0) & F.col("type_ok")
    return checked.where(good).drop("errors", "type_ok"), checked.where(~good)


def batch_duplicate_ids(raw: DataFrame) -> DataFrame:
    """Event ids that occur more than once within their batch."""
    return raw.groupBy("batch_id", "event_id").agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def batch_sizes(raw: DataFrame, cfg: BatchConfig = BatchConfig()) -> DataFrame:
    return raw.groupBy("batch_id").agg(F.count("*").alias("events")).withColumn(
        "accepted", F.col("events").between(1, cfg.max_events)
    )


def accepted_batches(raw: DataFrame) -> DataFrame:
    """Rows of batches with a legal size and no repeated event id."""
    too_big = batch_sizes(raw).where(~F.col("accepted")).select("batch_id")
    repeated = batch_duplicate_ids(raw).select("batch_id").distinct()
    return raw.join(too_big, "batch_id", "left_anti").join(repeated, "batch_id", "left_anti")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by ``order``: an aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")


def dedup_semantic(events: DataFrame) -> DataFrame:
    """Earliest event of each visitor, type and second, with the short label of the three."""
    keyed = events.withColumn("dedup_key", semantic_key(F.col("visitor_id"), F.col("event_type"), F.col("ts")))
    keyed = keyed.withColumn("_second", F.date_trunc("second", "ts"))
    return first_per_key(keyed, ["visitor_id", "event_type", "_second"], ["ts", "event_id"]).drop("_second")


def dedup_event_id(events: DataFrame) -> DataFrame:
    return first_per_key(events, ["event_id"], ["ts"])


def ingest_counts(batch: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Received, ingested and duplicate events per store for a batch against the stored ids."""
    per_id = batch.groupBy("event_id").agg(F.min("store_id").alias("store_id"), F.count("*").alias("copies"))
    known = stored_ids.select("event_id", F.lit(True).alias("known")).dropDuplicates(["event_id"])
    marked = per_id.join(known, "event_id", "left")
    fresh = F.when(F.col("known"), 0).otherwise(1)
    return marked.groupBy("store_id").agg(
        F.sum("copies").alias("received"), F.sum(fresh).alias("ingested"), F.sum(F.col("copies") - fresh).alias("duplicates")
    )


def zone_confidence(confidence: Column, zone: Column) -> Column:
    return F.round(confidence * F.when(zone.isNotNull(), 0.95).otherwise(1.0), 4)


def filter_detections(detections: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detections.where(
        (F.col("class_name") == "person") & (F.col("confidence") >= cfg.min_confidence)
        & (box_area(F.col("bbox")) >= cfg.min_area)
    )


def frame_timestamp(start: Column, frame: Column, fps: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + (frame / fps * 1e6).cast("long"))


def sample_frames(detections: DataFrame, fps: float, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    return detections.where(F.col("frame_idx") % max(1, int(fps / cfg.target_fps)) == 0)


def metadata_pack(session_seq: Column, queue_depth: Column, sku_zone: Column, bbox: Column, extras: Column) -> Column:
    """Event metadata as one JSON object; extras are merged in, but never dwell or queue depth."""
    core = F.to_json(
        F.struct(
            session_seq.alias("session_seq"), queue_depth.alias("queue_depth"),
            sku_zone.alias("sku_zone"), bbox.alias("bbox"),
        ),
        {"ignoreNullFields": "false"},
    )
    kept = F.map_filter(extras, lambda k, _: ~k.isin("dwell_seconds", "queue_depth"))
    tail = F.to_json(kept)
    merged = F.concat(F.regexp_replace(core, r"\}$", ","), F.regexp_replace(tail, r"^\{", ""))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, merged).otherwise(core)


def dwell_ms(dwell_seconds: Column) -> Column:
    return (dwell_seconds * 1000).cast("int")


def on_utc_day(events: DataFrame, day: Column) -> DataFrame:
    """Rows of one UTC day as a half-open time range, which prunes files and row groups."""
    start = day.cast("timestamp")
    return events.where((F.col("ts") >= start) & (F.col("ts") < F.date_add(day, 1).cast("timestamp")))
