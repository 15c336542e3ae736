"""Store-analytics view of the star-schema test tables, in Spark and as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.fixed_values import LAYOUT, ZONES
from dwellgrid.functions.hashing import session_key

DISPLAY_ZONES = [z[0] for z in ZONES if z[2] in ("DISPLAY", "AISLE")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind_events(table(spark, sf_dir, "events"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream (a glob, as a plain path must be a folder)."""
    schema = table(spark, sf_dir, "events").schema
    return bind_events(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))


def bind_events(table_rows: DataFrame) -> DataFrame:
    raw = table_rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    user, k, kind = F.col("user_id"), F.col("k"), F.col("event_type")
    store = F.format_string("STORE_%03d", user % 4)
    visitor = F.format_string("VIS_%06d", user)
    etype = (
        F.when(kind == "view", F.when(k < 50, "ENTRY").otherwise("ZONE_ENTER"))
        .when(kind == "click", F.when(k < 60, "ZONE_DWELL").otherwise("ZONE_EXIT"))
        .when(kind == "signup", F.when(k < 75, "BILLING_QUEUE_JOIN").otherwise("BILLING_QUEUE_ABANDON"))
        .when(kind == "purchase", "PURCHASE")
        .otherwise(F.when(k < 70, "EXIT").otherwise("REENTRY"))
    )
    zones = F.array(*[F.lit(z) for z in DISPLAY_ZONES])
    typed = raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        store.alias("store_id"),
        visitor.alias("visitor_id"),
        etype.alias("event_type"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id", "k", "value",
        (user % 25 == 0).alias("is_staff"),
        (F.lit(0.7) + k / 100 * 0.3).alias("confidence"),
    )
    e = F.col("event_type")
    in_zone, billing = e.startswith("ZONE_"), e.isin("BILLING_QUEUE_JOIN", "BILLING_QUEUE_ABANDON", "PURCHASE")
    day = F.to_date("ts")
    by_wire = (e == "ZONE_DWELL") & (F.col("k") % 7 == 3)  # dwell in its wire field instead of the metadata
    return typed.select(
        "*",
        day.alias("event_date"),
        F.when(in_zone, F.element_at(zones, (F.col("k") % 6 + 1).cast("int"))).when(billing, "Z_BILLING").alias("zone_id"),
        F.when(in_zone, "CAM_02").when(billing, "CAM_03").otherwise("CAM_01").alias("camera_id"),
        F.when((e == "ZONE_DWELL") & ~by_wire, F.to_json(F.struct((F.col("value") * 10).alias("dwell_seconds"))))
        .when(e == "BILLING_QUEUE_JOIN", F.to_json(F.struct((F.col("k") % 10).alias("queue_depth"))))
        .alias("metadata_json"),
        F.when(by_wire, (F.col("value") * 10 * 1000).cast("int")).otherwise(0).alias("dwell_ms"),
        session_key(F.col("visitor_id"), F.col("store_id"), day, F.lit(0)).alias("session_id"),
        F.struct(
            ((F.col("user_id") * 37) % 1180).cast("double").alias("x1"),
            ((F.col("k") * 7) % 520).cast("double").alias("y1"),
            ((F.col("user_id") * 37) % 1180 + 100).cast("double").alias("x2"),
            ((F.col("k") * 7) % 520 + 200).cast("double").alias("y2"),
        ).alias("bbox"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases_as_transactions(events(spark, sf_dir))


def purchases_as_transactions(bound: DataFrame) -> DataFrame:
    return bound.where(F.col("event_type") == "PURCHASE").select(
        F.col("event_id").alias("tx_id"), "store_id", F.col("value").alias("amount"), "ts",
        F.format_string("POS_%02d", F.col("k") % 3 + 1).alias("pos_terminal_id"),
    )


def _zone_array(zones) -> "F.Column":
    return F.array(*[
        F.struct(
            F.lit(i).alias("zone_ord"), F.lit(z).alias("zone_id"), F.lit(n).alias("zone_name"),
            F.lit(t).alias("zone_type"), F.lit(p).alias("priority"),
            F.array(*[F.array(*[F.lit(float(c)) for c in v]) for v in poly]).alias("polygon"),
        )
        for i, (z, n, t, p, poly) in enumerate(zones)
    ])


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("store_id").distinct()


def zones(spark: SparkSession, sf_dir: str, layout: bool = False) -> DataFrame:
    """One row per store of the data and zone of the fixed floor plan."""
    fixed = _zone_array(LAYOUT if layout else ZONES)
    return stores(spark, sf_dir).select("store_id", F.inline(fixed))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a sighting on a time-lapse camera feed with one frame per hour."""
    return as_detections(events(spark, sf_dir))


def as_detections(bound: DataFrame) -> DataFrame:
    return bound.select(
        "store_id", "camera_id", F.floor(F.unix_seconds("ts") / 3600).alias("frame_idx"), "ts",
        F.col("user_id").alias("track_id"), F.col("event_id").alias("detection_id"), "bbox", "confidence", "visitor_id",
    )


def camera_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an untracked detection on a camera with one frame a minute; less than half are sure."""
    return events(spark, sf_dir).select(
        "store_id", "camera_id", F.floor(F.unix_seconds("ts") / 60).alias("frame_idx"), F.col("event_id").alias("detection_id"),
        "bbox", (F.lit(0.35) + F.col("k") / 100 * 0.45).alias("confidence"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), "embedding")


# ---- the same binding as DuckDB CTEs ----

def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rnd(expr: str, digits: int) -> str:
    """Round half up on the decimal text of a double, as Spark's round does."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,16)), {digits}) AS DOUBLE)"


def xsum(expr: str) -> str:
    """Exact sum of doubles: their decimal texts are summed, and the sum's text becomes a double."""
    return f"CAST(CAST(sum(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,16))) AS VARCHAR) AS DOUBLE)"


_zone_case = " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(DISPLAY_ZONES))
_uuid5 = (
    "(SELECT substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||"
    "substr('89ab', (strpos('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12) "
    "FROM (SELECT sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode({name})) AS h))"
)


def uuid5_sql(name: str) -> str:
    return _uuid5.format(name=name)


EV = f"""raw_ev AS (
  SELECT event_id AS eid, ts, user_id, event_type AS kind, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
typed_ev AS (
  SELECT *, printf('STORE_%03d', user_id % 4) AS store_id, printf('VIS_%06d', user_id) AS visitor_id,
    CASE kind WHEN 'view' THEN CASE WHEN k < 50 THEN 'ENTRY' ELSE 'ZONE_ENTER' END
      WHEN 'click' THEN CASE WHEN k < 60 THEN 'ZONE_DWELL' ELSE 'ZONE_EXIT' END
      WHEN 'signup' THEN CASE WHEN k < 75 THEN 'BILLING_QUEUE_JOIN' ELSE 'BILLING_QUEUE_ABANDON' END
      WHEN 'purchase' THEN 'PURCHASE'
      ELSE CASE WHEN k < 70 THEN 'EXIT' ELSE 'REENTRY' END END AS event_type FROM raw_ev),
ev AS (
  SELECT CAST(eid AS VARCHAR) AS event_id, store_id, visitor_id, event_type, ts, user_id, k, value,
    strftime(ts, '%Y-%m-%d') AS event_date, user_id % 25 = 0 AS is_staff,
    CAST(0.7 AS DOUBLE) + CAST(k AS DOUBLE) / 100 * CAST(0.3 AS DOUBLE) AS confidence,
    CASE WHEN event_type LIKE 'ZONE%' THEN CASE k % 6 {_zone_case} END
         WHEN event_type IN ('BILLING_QUEUE_JOIN','BILLING_QUEUE_ABANDON','PURCHASE') THEN 'Z_BILLING' END AS zone_id,
    CASE WHEN event_type LIKE 'ZONE%' THEN 'CAM_02'
         WHEN event_type IN ('BILLING_QUEUE_JOIN','BILLING_QUEUE_ABANDON','PURCHASE') THEN 'CAM_03' ELSE 'CAM_01' END AS camera_id,
    CASE WHEN event_type = 'ZONE_DWELL' THEN CASE WHEN k % 7 <> 3 THEN value * 10
      WHEN trunc(value * 10 * 1000) > 0 THEN trunc(value * 10 * 1000) / 1000 END END AS dwell_seconds,
    CASE WHEN event_type = 'BILLING_QUEUE_JOIN' THEN k % 10 END AS queue_depth,
    visitor_id || ':' || store_id || ':' || strftime(ts, '%Y-%m-%d') || ':0' AS session_name,
    CAST((user_id * 37) % 1180 AS DOUBLE) AS x1, CAST((k * 7) % 520 AS DOUBLE) AS y1,
    CAST((user_id * 37) % 1180 + 100 AS DOUBLE) AS x2, CAST((k * 7) % 520 + 200 AS DOUBLE) AS y2
  FROM typed_ev)"""

TX = """tx AS (SELECT event_id AS tx_id, store_id, value AS amount, ts,
  printf('POS_%02d', k % 3 + 1) AS pos_terminal_id FROM ev WHERE event_type = 'PURCHASE')"""


def _zone_values(zones) -> str:
    return ", ".join(f"({i}, '{z}', '{n}', '{t}', {p})" for i, (z, n, t, p, _) in enumerate(zones))


ZN = f"""zn AS (SELECT s.store_id, z.* FROM (SELECT DISTINCT store_id FROM ev) s,
  (VALUES {_zone_values(ZONES)}) z(zone_ord, zone_id, zone_name, zone_type, priority))"""
