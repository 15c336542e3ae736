"""Readers: event JSON, POS CSV, store layouts and partitioned tables, always with a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.fixed_values import EVENT_TYPES
from dwellgrid.functions.hashing import uuid5
from dwellgrid.operators.quality import field_errors, parse_utc

EVENT_SCHEMA = (
    "event_id string, store_id string, camera_id string, visitor_id string, event_type string, timestamp string, "
    "zone_id string, dwell_ms int, is_staff boolean, confidence double, metadata string"
)
BROKEN = "_broken"
POS_SCHEMA = "tx_id string, amount double, timestamp string, pos_terminal_id string"
LAYOUT_SCHEMA = (
    "stores array<struct<store_id:string,name:string,timezone:string,floor_plan:struct<width:int,height:int>,"
    "zones:array<struct<zone_id:string,name:string,zone_type:string,priority:int,polygon:array<array<double>>>>>>"
)


def with_event_defaults(raw: DataFrame) -> DataFrame:
    """Typed events: missing ids are derived from the content (so a retried task repeats them), other fields get defaults."""
    derived = uuid5(F.concat_ws("|", "store_id", "visitor_id", "event_type", "timestamp", "camera_id"))
    return raw.select(
        F.coalesce("event_id", derived).alias("event_id"), "store_id", "camera_id", "visitor_id", "event_type",
        parse_utc(F.col("timestamp")).alias("ts"), "zone_id", F.coalesce("dwell_ms", F.lit(0)).alias("dwell_ms"),
        F.coalesce("is_staff", F.lit(False)).alias("is_staff"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.col("metadata").alias("metadata_json"),
    )


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(raw, event fields, unreadable) of a text column with one JSON object per row; blank rows are no records.

    A row is unreadable if it is no JSON object or a field has another type than the schema says."""
    shape = f"{EVENT_SCHEMA}, {BROKEN} string"
    text = F.col(column)
    event = F.from_json(text, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = lines.where(F.length(F.trim(text)) > 0).select(text.alias("raw"), event.alias("e"))
    # an array or a bare value is no event, and nothing may follow the object
    alone = F.coalesce(F.json_array_length(F.concat(F.lit("["), "raw", F.lit("]"))) == 1, F.lit(False))
    whole = F.json_object_keys("raw").isNotNull() & alone
    return rows.select("raw", "e.*", (F.col(f"e.{BROKEN}").isNotNull() | ~whole).alias("unreadable")).drop(BROKEN)


def wire_problems() -> Column:
    """Names of what is wrong with a parsed line, after defaults: unreadable, or the fields that break a rule."""
    kind = F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    meta = F.col("metadata").isNull() | F.json_object_keys("metadata").isNotNull()
    fields = F.concat(
        field_errors(), F.array_compact(F.array(F.when(~kind, F.lit("event_type")), F.when(~meta, F.lit("metadata"))))
    )
    return F.when(F.col("unreadable"), F.array(F.lit("unreadable"))).otherwise(fields)


def checked_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parsed lines with ``problems``; every line that is not blank is one row, so none is lost."""
    parsed = parse_lines(lines, column)
    defaults = parsed.withColumn("confidence", F.coalesce("confidence", F.when(~F.col("unreadable"), F.lit(1.0))))
    return defaults.withColumn("problems", wire_problems()).drop("unreadable")


def good_events(checked: DataFrame) -> DataFrame:
    return with_event_defaults(checked.where(F.size("problems") == 0))


def quarantined(checked: DataFrame) -> DataFrame:
    """(raw, problems) of the lines that were turned away."""
    return checked.where(F.size("problems") > 0).select("raw", "problems")


def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from a text column with one JSON object per row; unreadable rows are left to ``quarantined``."""
    return with_event_defaults(parse_lines(lines, column).where(~F.col("unreadable")))


def read_event_lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths))


def stream_event_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def read_events_json(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines of one or more feeds; several paths (one per camera, say) are read as one table."""
    return parse_event_lines(read_event_lines(spark, *paths))


def stream_events_json(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return parse_event_lines(stream_event_lines(spark, path, files_per_trigger))


def read_pos_csv(spark: SparkSession, path: str, store_id: Column | None = None) -> DataFrame:
    """POS files of one store, or of a folder partitioned by store_id when no store is given."""
    schema = POS_SCHEMA if store_id is not None else POS_SCHEMA + ", store_id string"
    raw = spark.read.schema(schema).option("header", True).csv(path)
    raw = raw if store_id is None else raw.withColumn("store_id", store_id)
    derived = uuid5(F.concat_ws("|", "store_id", "timestamp", "pos_terminal_id", F.col("amount").cast("string")))
    return raw.select(
        F.coalesce("tx_id", derived).alias("tx_id"), "store_id", F.coalesce("amount", F.lit(0.0)).alias("amount"),
        parse_utc(F.col("timestamp")).alias("ts"), "pos_terminal_id",
    )


def layout_zones(layouts: DataFrame, store_id: str | None = None) -> DataFrame:
    """One row per zone of nested layouts."""
    stores = layouts.select(F.inline("stores"))
    if store_id is not None:
        stores = stores.where(F.col("store_id") == store_id)
    zones = stores.select("store_id", F.posexplode("zones").alias("zone_ord", "z"))
    return zones.select(
        "store_id", "zone_ord", "z.zone_id", F.col("z.name").alias("zone_name"), "z.zone_type",
        F.coalesce("z.priority", F.lit(0)).alias("priority"), "z.polygon",
    )


def read_layout(spark: SparkSession, path: str, store_id: str | None = None, multi_line: bool = True) -> DataFrame:
    return layout_zones(spark.read.schema(LAYOUT_SCHEMA).option("multiLine", multi_line).json(path), store_id)


def scan_days(table: DataFrame, first_day: Column, last_day: Column, store_id: str | None = None) -> DataFrame:
    """Range scan on the partition columns store_id and event_date."""
    rows = table.where(F.col("event_date").between(first_day, last_day))
    return rows if store_id is None else rows.where(F.col("store_id") == store_id)
