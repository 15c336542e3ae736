"""Registered queries: scans, sinks and table merges. File formats make a round trip through the shared folder."""

from pyspark.sql import functions as F

from dwellgrid.fixed_values import LAYOUT
from dwellgrid.operators import rollups, sessions
from dwellgrid.plans import binding as b
from dwellgrid.plans import derived as d
from dwellgrid.plans.binding import EV, TX, ZN, uuid5_sql, with_ctes
from dwellgrid.plans.derived import DAILY, HOURLY, SESS
from dwellgrid.plans.funnel_queries import ZLIST
from dwellgrid.plans.quality_queries import REPLAY, replayed
from dwellgrid.plans.registry import query
from dwellgrid.session import cut_lineage, scratch_path
from dwellgrid.sources import readers, writers

DERIVED_ID = uuid5_sql("store_id || '|' || visitor_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00|' || camera_id")


def wire_events(spark, sf):
    """Events with the gaps a feed shows: no id, no staff flag, no dwell."""
    ev = b.events(spark, sf)
    return ev.withColumn("event_id", F.when(F.col("k") != 93, F.col("event_id"))).withColumn(
        "is_staff", F.when(F.col("is_staff"), True)
    ).withColumn("dwell_ms", (rollups.event_dwell(ev) * 1000).cast("int"))


_wire = f"""SELECT CASE WHEN k <> 93 THEN event_id ELSE {DERIVED_ID} END AS event_id, store_id, camera_id, event_type, ts, zone_id,
  CAST(coalesce(trunc(dwell_seconds * 1000), 0) AS INTEGER) AS dwell_ms, is_staff FROM ev"""
WIRE_COLS = ["event_id", "store_id", "camera_id", "event_type", "ts", "zone_id", "dwell_ms", "is_staff"]


@query("scan_events_json", with_ctes(_wire, EV))
def _(spark, sf):
    return readers.parse_event_lines(writers.event_lines(wire_events(spark, sf))).select(*WIRE_COLS)


@query("scan_events_jsonl", with_ctes(_wire, EV))
def _(spark, sf):
    path = scratch_path(spark, "events-jsonl")
    writers.write_event_lines(wire_events(spark, sf), path)
    return readers.read_events_json(spark, path).select(*WIRE_COLS)


def damaged_lines(spark, sf):
    """The events as lines of which some are cut off, mistyped, incomplete or against a rule."""
    # a table in few files is read by few tasks: its narrow rows are spread before they become lines
    rows = b.table(spark, sf, "events").repartition(4 * spark.sparkContext.defaultParallelism)
    ev = b.bind_events(rows).withColumn("dwell_ms", F.lit(0)).withColumn("store_id", F.when(F.col("k") != 94, F.col("store_id")))
    ev = ev.withColumn("confidence", F.when(F.col("k") == 95, 1.7).when(F.col("k") != 90, F.col("confidence")))
    ev = ev.withColumn("event_type", F.when(F.col("k") == 96, "INVALID_TYPE").otherwise(F.col("event_type")))
    ev = ev.withColumn("metadata_json", F.when(F.col("k") == 89, "[1]").otherwise(F.col("metadata_json")))
    lines, text = writers.event_lines(ev, "k"), F.col("value")
    broken = (
        F.when(F.col("k") == 91, F.expr("substr(value, 1, length(value) - 5)"))
        .when(F.col("k") == 92, F.regexp_replace(text, '"confidence":[0-9.]+', '"confidence":"high"'))
        .when(F.col("k") == 93, F.concat(F.lit("["), text, F.lit("]")))
        .when(F.col("k") == 97, F.regexp_replace(text, '"timestamp":"[^"]+"', '"timestamp":"yesterday"'))
        .otherwise(text)
    )
    return lines.select(broken.alias("value"))


DAMAGE = """SELECT event_id, CASE WHEN k IN (91, 92, 93) THEN 'unreadable' WHEN k = 94 THEN 'store_id' WHEN k = 95 THEN 'confidence'
  WHEN k = 96 THEN 'event_type' WHEN k = 97 THEN 'timestamp' WHEN k = 89 THEN 'metadata' ELSE '' END AS problems FROM ev"""


def told_apart(events, turned_away):
    """Every line once: good ones by their event, the others by the id that their text still shows."""
    raw_id = F.regexp_extract("raw", '"event_id":"([^"]+)"', 1)
    return events.select("event_id", F.lit("").alias("problems")).unionByName(
        turned_away.select(raw_id.alias("event_id"), F.array_join("problems", ",").alias("problems")))


@query("wire_quarantine", with_ctes(DAMAGE, EV))
def _(spark, sf):
    path = scratch_path(spark, "damaged")
    damaged_lines(spark, sf).write.text(path)
    checked = readers.checked_lines(readers.read_event_lines(spark, path))
    return told_apart(readers.good_events(checked), readers.quarantined(checked))


@query("sink_events_jsonl", with_ctes("""SELECT event_id, event_type, zone_id, is_staff, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp
  FROM ev""", EV))
def _(spark, sf):
    path = scratch_path(spark, "event-lines")
    writers.write_event_lines(b.events(spark, sf).withColumn("dwell_ms", F.lit(0)), path)
    line = spark.read.text(path)
    return line.select(
        *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("event_id", "event_type", "zone_id")],
        F.get_json_object("value", "$.is_staff").cast("boolean").alias("is_staff"), F.get_json_object("value", "$.timestamp").alias("stamp"))


@query("scan_pos_csv", with_ctes("""SELECT tx_id, store_id, CASE WHEN CAST(tx_id AS BIGINT) % 10 = 0 THEN 0 ELSE amount END AS amount, ts,
  pos_terminal_id FROM tx""", EV, TX))
def _(spark, sf):
    path = scratch_path(spark, "pos-csv")
    tx = b.transactions(spark, sf)
    amount = F.when(F.col("tx_id").cast("long") % 10 != 0, F.col("amount")).alias("amount")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp")
    tx.select("tx_id", amount, stamp, "pos_terminal_id", "store_id").write.partitionBy("store_id").option("header", True).csv(path)
    return readers.read_pos_csv(spark, path)


_layout_rows = ", ".join(f"({i}, '{z}', '{t}', {p})" for i, (z, _n, t, p, _) in enumerate(LAYOUT))


@query("scan_store_layout", with_ctes(f"""SELECT s.store_id, l.* FROM (SELECT DISTINCT store_id FROM ev) s,
  (VALUES {_layout_rows}) l(zone_ord, zone_id, zone_type, priority)""", EV))
def _(spark, sf):
    path = scratch_path(spark, "layout")
    plan = b.zones(spark, sf, layout=True).groupBy("store_id").agg(F.sort_array(F.collect_list(
        F.struct("zone_ord", "zone_id", F.col("zone_name").alias("name"), "zone_type", "priority", "polygon"))).alias("zones"))
    nested = plan.select(F.array(F.struct("store_id", F.col("store_id").alias("name"), F.lit("UTC").alias("timezone"), "zones")).alias("stores"))
    nested.write.json(path)
    return readers.read_layout(spark, path, multi_line=False).select("store_id", "zone_ord", "zone_id", "zone_type", "priority")


@query("scan_table_pruned", with_ctes("""SELECT store_id, event_date, event_id, event_type FROM ev
  WHERE event_date >= strftime((SELECT max(ts) FROM ev) - INTERVAL 6 DAY, '%Y-%m-%d')""", EV))
def _(spark, sf):
    path = scratch_path(spark, "events-by-day")
    ev = b.events(spark, sf)
    writers.write_partitioned(ev.select("store_id", "event_date", "ts", "event_id", "event_type"), path)
    day = F.to_date(d.latest(spark, sf))
    return readers.scan_days(spark.read.parquet(path), F.date_sub(day, 6), day).select("store_id", "event_date", "event_id", "event_type")


@query("sink_insert_ignore", with_ctes("""SELECT event_id, store_id, ts, CASE WHEN event_type = 'PURCHASE' THEN 'stored' ELSE 'new' END AS origin
  FROM ev""", EV, REPLAY))
def _(spark, sf):
    cols = ["event_id", "store_id", "ts"]
    path = scratch_path(spark, "event-table")
    b.events(spark, sf).where(F.col("event_type") == "PURCHASE").select(*cols, F.lit("stored").alias("origin")).write.parquet(path)
    batch = replayed(spark, sf).select(*cols, F.lit("new").alias("origin"))
    for _ in range(2):  # the replay adds nothing
        writers.insert_ignore_into(path, batch, "event_id", ["ts"])
    return spark.read.parquet(path)


MERGE = """half AS (SELECT session_name, store_id, visitor_id, hour(ts) >= 12 AS late, min(ts) AS e, max(ts) FILTER (event_type = 'EXIT') AS x,
  bool_or(event_type = 'REENTRY') AS r, bool_or(event_type = 'PURCHASE') AS c FROM ev GROUP BY 1, 2, 3, 4),
merged AS (SELECT session_name, o.store_id AS os, n.store_id AS ns, coalesce(o.store_id, n.store_id) AS store_id,
  coalesce(o.visitor_id, n.visitor_id) AS visitor_id, coalesce(o.e, n.e) AS entry_time, coalesce(n.x, o.x) AS exit_time,
  coalesce(epoch_us(n.x) - epoch_us(coalesce(o.e, n.e)), epoch_us(o.x) - epoch_us(o.e)) / CAST(1e6 AS DOUBLE) AS dwell_seconds,
  coalesce(o.c, false) OR coalesce(n.c, false) AS is_converted, coalesce(o.r, n.r) AS is_reentry
  FROM (SELECT * FROM half WHERE NOT late) o FULL JOIN (SELECT * FROM half WHERE late) n USING (session_name))"""


@query("sink_upsert_sessions", with_ctes(f"""SELECT {uuid5_sql('m.session_name')} AS session_id, store_id, visitor_id, entry_time, exit_time,
  dwell_seconds, is_converted, is_reentry, coalesce(zones, '') AS zones_visited FROM merged m LEFT JOIN zl USING (session_name)""", EV, MERGE, ZLIST))
def _(spark, sf):
    ev, path = b.events(spark, sf), scratch_path(spark, "session-table")
    old, new = (
        sessions.session_fold(ev.where(half)).withColumn("event_date", F.to_date("entry_time"))
        for half in (F.hour("ts") < 12, F.hour("ts") >= 12)
    )
    writers.overwrite_partitions(old, path, "event_date")
    writers.upsert_sessions_into(path, new)
    out = spark.read.schema(new.schema).parquet(path)
    return out.drop("is_staff", "event_date").withColumn("zones_visited", F.array_join("zones_visited", ","))


RECENT = "(SELECT max(ts) FROM ev) - INTERVAL 7 DAY"


@query("sink_upsert_hourly", with_ctes(f"""SELECT store_id, hour_bucket, unique_visitors,
  CASE WHEN (store_id, hour_bucket) IN (SELECT store_id, date_trunc('hour', ts) FROM ev WHERE ts >= {RECENT}) THEN conversions ELSE 0 END AS conversions
  FROM hourly""", EV, TX, SESS, HOURLY))
def _(spark, sf):
    path, as_of = scratch_path(spark, "hourly"), d.latest(spark, sf)
    cols = [*rollups.HOUR, "event_date", "unique_visitors", "conversions"]
    before = d.hourly_table(spark, sf).withColumn("event_date", F.to_date("hour_bucket")).select(cols)
    writers.overwrite_partitions(before.withColumn("conversions", F.lit(0).cast("long")), path, "event_date")
    events = b.events(spark, sf)
    touched = cut_lineage(rollups.affected_buckets(events.where(F.col("ts") >= as_of - F.expr("interval 7 days"))))
    fresh = rollups.refreshed_hours(events, touched, b.purchases_as_transactions, as_of).select(cols)
    writers.upsert_rows_into(path, fresh, rollups.HOUR)
    return spark.read.schema(fresh.schema).parquet(path).drop("event_date")


@query("sink_upsert_daily", with_ctes(f"""SELECT store_id, event_date, unique_visitors,
  CASE WHEN (store_id, event_date) IN (SELECT store_id, event_date FROM ev WHERE ts >= {RECENT}) THEN conversions ELSE 0 END AS conversions
  FROM daily""", EV, TX, SESS, HOURLY, DAILY))
def _(spark, sf):
    path, keys, as_of = scratch_path(spark, "daily"), ["store_id", "event_date"], d.latest(spark, sf)
    cols = [*keys, "unique_visitors", "conversions"]
    before = d.daily_table(spark, sf).select(cols).withColumn("conversions", F.lit(0).cast("long"))
    writers.overwrite_partitions(before, path, "event_date")
    events = b.events(spark, sf)
    touched = cut_lineage(rollups.affected_buckets(events.where(F.col("ts") >= as_of - F.expr("interval 7 days"))))
    fresh = rollups.refreshed_days(events, touched, b.purchases_as_transactions, as_of).select(cols)
    writers.upsert_rows_into(path, fresh, keys)
    return spark.read.schema(fresh.schema).parquet(path)


@query("upsert_zones", with_ctes("""SELECT store_id, zone_id, 'ignore' AS mode, CASE WHEN zone_type = 'DISPLAY' THEN 'Old ' || zone_name ELSE zone_name END AS zone_name FROM zn
  UNION ALL SELECT store_id, zone_id, 'overwrite', zone_name FROM zn""", EV, ZN))
def _(spark, sf):
    new = b.zones(spark, sf).drop("polygon")
    known = new.where(F.col("zone_type") == "DISPLAY").withColumn("zone_name", F.concat(F.lit("Old "), "zone_name"))
    parts = []
    for mode in ("ignore", "overwrite"):
        path = scratch_path(spark, f"zone-table-{mode}")
        writers.overwrite_partitions(known, path, "store_id")
        writers.upsert_zones_into(path, new, mode)
        stored = spark.read.schema(new.schema).parquet(path)
        parts.append(stored.select("store_id", "zone_id", F.lit(mode).alias("mode"), "zone_name"))
    return parts[0].unionByName(parts[1])


@query("auto_register_store", with_ctes("""SELECT DISTINCT store_id, store_id AS name, 'Asia/Kolkata' AS timezone FROM ev
  WHERE store_id NOT IN (SELECT arg_min(store_id, ts) FROM ev)""", EV))
def _(spark, sf):
    ev, path = b.events(spark, sf), scratch_path(spark, "store-table")
    first = ev.agg(F.min_by("store_id", "ts").alias("store_id"))
    first.select("store_id", F.lit("known").alias("name"), F.lit("UTC").alias("timezone")).write.parquet(path)
    for _ in range(2):  # a store is registered once
        writers.register_stores_into(path, ev)
    return spark.read.parquet(path).where("name <> 'known'")


@query("concat_camera_files", with_ctes("SELECT event_id, camera_id, event_type FROM ev", EV))
def _(spark, sf):
    path = scratch_path(spark, "camera-feeds")
    writers.write_camera_feeds(b.events(spark, sf).withColumn("dwell_ms", F.lit(0)), path)
    return readers.read_events_json(spark, path).select("event_id", "camera_id", "event_type")
