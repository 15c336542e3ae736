"""Registered queries: validation, deduplication and enrichment."""

from pyspark.sql import functions as F

from dwellgrid.functions.hashing import track_number
from dwellgrid.functions.scoring import calibrated_confidence
from dwellgrid.operators import funnel, quality, rollups
from dwellgrid.plans import binding as b
from dwellgrid.plans.binding import EV, rnd, with_ctes
from dwellgrid.plans.registry import query

RAW = """raw AS (SELECT CASE WHEN k = 96 THEN CAST(CAST(event_id AS BIGINT) - 1 AS VARCHAR) ELSE event_id END AS event_id,
  CASE WHEN (CAST(event_id AS BIGINT) // 3000) % 2 = 0 THEN CAST(event_id AS BIGINT) // 600
    ELSE 1000000 + CAST(event_id AS BIGINT) // 300 END AS batch_id,
  store_id, CASE WHEN k = 95 THEN NULL ELSE camera_id END AS camera_id,
  CASE WHEN k = 94 THEN '' ELSE visitor_id END AS visitor_id,
  CASE WHEN k = 98 THEN 'INVALID_TYPE' ELSE event_type END AS event_type,
  k = 97 AS bad_ts, value / 250 AS confidence FROM ev)"""


def raw_events(spark, sf):
    """The events as received: text times, batches, and the kinds of faults a feed shows."""
    eid, k = F.col("event_id").cast("long"), F.col("k")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return b.events(spark, sf).select(
        F.when(k == 96, (eid - 1).cast("string")).otherwise(F.col("event_id")).alias("event_id"),
        F.when(F.floor(eid / 3000) % 2 == 0, F.floor(eid / 600)).otherwise(F.lit(1000000) + F.floor(eid / 300)).alias("batch_id"),
        "store_id", F.when(k != 95, F.col("camera_id")).alias("camera_id"),
        F.when(k == 94, "").otherwise(F.col("visitor_id")).alias("visitor_id"),
        F.when(k == 98, "INVALID_TYPE").otherwise(F.col("event_type")).alias("event_type"),
        F.when(k == 97, "n/a").otherwise(iso).alias("timestamp"), (F.col("value") / 250).alias("confidence"),
        "zone_id", "is_staff", "metadata_json",
    )


def replayed(spark, sf):
    """Events with re-delivered copies, as an at-least-once feed sends them."""
    ev = b.events(spark, sf)
    return ev.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("k") < 20, 2).otherwise(1))))


_types = "('ENTRY','EXIT','ZONE_ENTER','ZONE_EXIT','ZONE_DWELL','BILLING_QUEUE_JOIN','BILLING_QUEUE_ABANDON','REENTRY'"


@query("valid_event_type", with_ctes(f"""SELECT event_id, batch_id, event_type, event_type IN {_types},'PURCHASE') AS type_ok,
  event_type IN {_types}) AS generator_type_ok FROM raw""", EV, RAW))
def _(spark, sf):
    return quality.check_both_type_sets(raw_events(spark, sf)).select(
        "event_id", "batch_id", "event_type", "type_ok", "generator_type_ok")


@query("valid_fields", with_ctes("""SELECT event_id, batch_id, concat_ws(',', CASE WHEN visitor_id = '' THEN 'visitor_id' END,
  CASE WHEN camera_id IS NULL THEN 'camera_id' END, CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END,
  CASE WHEN bad_ts THEN 'timestamp' END) AS errors FROM raw""", EV, RAW))
def _(spark, sf):
    out = quality.validate_fields(raw_events(spark, sf))
    return out.select("event_id", "batch_id", F.array_join("errors", ",").alias("errors"))


@query("batch_duplicate_ids", with_ctes(
    "SELECT batch_id, event_id, count(*) AS copies FROM raw GROUP BY 1, 2 HAVING count(*) > 1", EV, RAW))
def _(spark, sf):
    return quality.batch_duplicate_ids(raw_events(spark, sf))


@query("batch_size_check", with_ctes(
    "SELECT batch_id, count(*) AS events, count(*) BETWEEN 1 AND 500 AS accepted FROM raw GROUP BY 1", EV, RAW))
def _(spark, sf):
    return quality.batch_sizes(raw_events(spark, sf))


REPLAY = "replay AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE k < 20)"
SEMKEY = "substr(sha256(visitor_id || ':' || event_type || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'), 1, 16)"


@query("dedup_semantic", with_ctes(f"""SELECT dedup_key, event_id, ts FROM (SELECT {SEMKEY} AS dedup_key, event_id, ts,
  row_number() OVER (PARTITION BY visitor_id, event_type, date_trunc('second', ts) ORDER BY ts, event_id) AS rn FROM replay) WHERE rn = 1""", EV, REPLAY))
def _(spark, sf):
    ev = replayed(spark, sf).select("event_id", "visitor_id", "event_type", "ts")
    return quality.dedup_semantic(ev).select("dedup_key", "event_id", "ts")


@query("dedup_event_id", with_ctes("""SELECT store_id, CAST(sum(copies) AS BIGINT) AS received,
  CAST(sum(fresh) AS BIGINT) AS ingested, CAST(sum(copies - fresh) AS BIGINT) AS duplicates FROM (
    SELECT event_id, min(store_id) AS store_id, count(*) AS copies,
      CASE WHEN bool_or(event_type = 'PURCHASE') THEN 0 ELSE 1 END AS fresh FROM replay GROUP BY 1) GROUP BY 1""", EV, REPLAY))
def _(spark, sf):
    stored = b.events(spark, sf).where(F.col("event_type") == "PURCHASE").select("event_id")
    return quality.ingest_counts(replayed(spark, sf), stored)


@query("normalise_utc", with_ctes("SELECT event_id, ts FROM ev", EV))
def _(spark, sf):
    naive = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shifted = F.date_format(F.col("ts") + F.expr("interval 330 minutes"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+05:30'")
    text = b.events(spark, sf).select("event_id", F.when(F.col("k") % 2 == 0, shifted).otherwise(naive).alias("text"))
    return text.select("event_id", quality.parse_utc(F.col("text")).alias("ts"))


@query("zone_confidence", with_ctes(f"""SELECT event_id,
  {rnd('confidence * CASE WHEN zone_id IS NOT NULL THEN CAST(0.95 AS DOUBLE) ELSE 1 END', 4)} AS confidence FROM ev""", EV))
def _(spark, sf):
    c = quality.zone_confidence(F.col("confidence"), F.col("zone_id"))
    return b.events(spark, sf).select("event_id", c.alias("confidence"))


@query("calibrate_confidence", with_ctes(
    f"SELECT event_id, {rnd('1 / (1 + exp(-(confidence - 0.5) * 12))', 4)} AS calibrated FROM ev", EV))
def _(spark, sf):
    return b.events(spark, sf).select("event_id", calibrated_confidence(F.col("confidence")).alias("calibrated"))


@query("filter_detections", with_ctes("""SELECT event_id AS detection_id, k / CAST(100 AS DOUBLE) AS confidence FROM ev
  WHERE k % 10 <> 0 AND k / CAST(100 AS DOUBLE) >= 0.35 AND k * 10 >= 400""", EV))
def _(spark, sf):
    box = F.struct(
        F.col("bbox.x1").alias("x1"), F.col("bbox.y1").alias("y1"),
        (F.col("bbox.x1") + F.col("k")).alias("x2"), (F.col("bbox.y1") + 10).alias("y2"))
    det = b.events(spark, sf).select(
        F.col("event_id").alias("detection_id"), (F.col("k") / 100).alias("confidence"), box.alias("bbox"),
        F.when(F.col("k") % 10 == 0, "bag").otherwise("person").alias("class_name"))
    return quality.filter_detections(det).select("detection_id", "confidence")


FRAMES = """frames AS (SELECT event_id AS detection_id, date_trunc('day', ts) AS start_ts,
  CAST(floor((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / CAST(1e6 AS DOUBLE) * 15) AS BIGINT) AS frame_idx FROM ev)"""


def frames(spark, sf):
    start = F.date_trunc("day", "ts")
    idx = F.floor((F.unix_micros("ts") - F.unix_micros(start)) / 1e6 * 15)
    return b.events(spark, sf).select(F.col("event_id").alias("detection_id"), start.alias("start_ts"), idx.alias("frame_idx"))


@query("frame_timestamp", with_ctes("""SELECT detection_id, frame_idx,
  start_ts + to_microseconds(CAST(trunc(frame_idx / CAST(15 AS DOUBLE) * 1e6) AS BIGINT)) AS frame_ts FROM frames""", EV, FRAMES))
def _(spark, sf):
    ts = quality.frame_timestamp(F.col("start_ts"), F.col("frame_idx"), F.lit(15.0))
    return frames(spark, sf).select("detection_id", "frame_idx", ts.alias("frame_ts"))


@query("frame_sampling", with_ctes("SELECT detection_id, frame_idx FROM frames WHERE frame_idx % 3 = 0", EV, FRAMES))
def _(spark, sf):
    return quality.sample_frames(frames(spark, sf), 15.0).select("detection_id", "frame_idx")


@query("metadata_pack", with_ctes("""SELECT event_id, '{"session_seq":' || CAST(k AS VARCHAR) || ',"queue_depth":' ||
  coalesce(CAST(queue_depth AS VARCHAR), 'null') || ',"sku_zone":' || coalesce('"' || zone_id || '"', 'null') ||
  ',"bbox":{"x1":' || CAST(x1 AS VARCHAR) || ',"y1":' || CAST(y1 AS VARCHAR) || ',"x2":' || CAST(x2 AS VARCHAR) ||
  ',"y2":' || CAST(y2 AS VARCHAR) || '},"reason":"' || lower(event_type) || '"}' AS metadata FROM ev""", EV))
def _(spark, sf):
    depth = rollups.queue_depth_of(F.col("metadata_json"))
    extras = F.create_map(
        F.lit("reason"), F.lower("event_type"), F.lit("dwell_seconds"), F.col("value").cast("string"),
        F.lit("queue_depth"), F.col("k").cast("string"))
    packed = quality.metadata_pack(F.col("k"), depth, F.col("zone_id"), F.col("bbox"), extras)
    return b.events(spark, sf).select("event_id", packed.alias("metadata"))


@query("metadata_extract", with_ctes(
    "SELECT event_id, dwell_seconds, CAST(queue_depth AS DOUBLE) AS queue_depth FROM ev", EV))
def _(spark, sf):
    m = F.col("metadata_json")
    return b.events(spark, sf).select(
        "event_id", rollups.event_dwell(b.events(spark, sf)).alias("dwell_seconds"),
        rollups.queue_depth_of(m).cast("double").alias("queue_depth"))


@query("dwell_ms_convert", with_ctes(
    "SELECT event_id, CAST(trunc(dwell_seconds * 1000) AS INTEGER) AS dwell_ms FROM ev WHERE event_type = 'ZONE_DWELL'", EV))
def _(spark, sf):
    ev = b.events(spark, sf).where(F.col("event_type") == "ZONE_DWELL")
    return ev.select("event_id", quality.dwell_ms(rollups.event_dwell(ev)).alias("dwell_ms"))


@query("raw_track_number", with_ctes("SELECT event_id, CAST(user_id AS VARCHAR) AS track_no, CAST(user_id % 4 AS VARCHAR) AS store_no FROM ev", EV))
def _(spark, sf):
    return b.events(spark, sf).select(
        "event_id", track_number(F.col("visitor_id")).alias("track_no"), track_number(F.col("store_id")).alias("store_no"))


@query("utc_day_filter", with_ctes(
    "SELECT event_id, ts, event_type FROM ev WHERE event_date = (SELECT max(event_date) FROM ev)", EV))
def _(spark, sf):
    ev = b.events(spark, sf)
    day = ev.agg(F.max("event_date")).scalar()
    return quality.on_utc_day(ev, day).select("event_id", "ts", "event_type")


@query("staff_exclusion", with_ctes("SELECT event_id, visitor_id, event_type FROM ev WHERE NOT is_staff", EV))
def _(spark, sf):
    return funnel.not_staff(b.events(spark, sf)).select("event_id", "visitor_id", "event_type")


