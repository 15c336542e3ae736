"""Registered queries: streaming forms, run over everything available. The feeds end with a heartbeat, so that streams
close their open windows themselves and results come from the sinks alone."""

from pyspark.sql import functions as F

from dwellgrid.functions.scoring import seconds_between
from dwellgrid.operators import identity
from dwellgrid.plans import binding as b
from dwellgrid.plans import derived as d
from dwellgrid.plans.anomaly_queries import ALERTS, ANOM, BASE, SIG, rec
from dwellgrid.plans.binding import EV, rnd, uuid5_sql, with_ctes
from dwellgrid.plans.identity_queries import EMB, LINKS, ROOTS, fold_sql, recursive
from dwellgrid.plans.movement_queries import GAPS, QUEUE
from dwellgrid.plans.quality_queries import REPLAY, SEMKEY, replayed
from dwellgrid.plans.registry import query
from dwellgrid.plans.source_queries import DAMAGE, damaged_lines, told_apart
from dwellgrid.session import cut_lineage, scratch_path
from dwellgrid.sources import readers, writers
from dwellgrid.streaming import batches, flows, heartbeat, identities, queue
from dwellgrid.streaming.jobs import DELAY, continue_job, rocksdb_state, run_available, run_batches, run_parts

def closing_stream(spark, sf, delay=DELAY):
    """The events table as a stream whose feeds end: a last heartbeat of each store closes what is open."""
    path = scratch_path(spark, "heartbeats")
    heartbeat.final_heartbeats(b.events(spark, sf)).write.parquet(path)
    beats = spark.readStream.schema(heartbeat.BEAT_SCHEMA).parquet(path)
    return heartbeat.on_feed_clock(heartbeat.with_heartbeats(b.events_stream(spark, sf), beats), delay)


def growing(spark, parts):
    """A feed that grows by one folder at a time, each with the partitions of its rows: the stream after each."""
    path = scratch_path(spark, "growing")
    for i, rows in enumerate(parts):
        rows.write.parquet(f"{path}/{i}")
        yield spark.readStream.schema(rows.schema).parquet(f"{path}/*")


def interleaved(spark, sf, parts=3):
    """The events in several parts that all reach over the whole time: every hour is re-opened."""
    raw = b.table(spark, sf, "events")
    part = F.pmod(F.xxhash64("event_id"), F.lit(parts))
    for stream in growing(spark, (raw.where(part == i) for i in range(parts))):
        yield b.bind_events(stream)


def arriving(spark, sf, parts=4):
    """The events as a stream that grows: after each step the next stretch of time has arrived, in its own folder."""
    raw = b.table(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = raw.select(us.alias("us")).agg(
        F.percentile_approx("us", [i / parts for i in range(1, parts)], 1000).alias("cuts")).first().cuts or []
    edges = [None, *sorted(set(ends)), None]
    inside = [(F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high) for low, high in zip(edges, edges[1:])]
    for stream in growing(spark, (raw.where(part) for part in inside)):
        yield b.bind_events(stream)


@query("stream_ingest", with_ctes("SELECT event_id, store_id, event_type, ts FROM ev WHERE k <> 98", EV))
def _(spark, sf):
    path = scratch_path(spark, "feed")
    sent = replayed(spark, sf).withColumn("dwell_ms", F.lit(0)).withColumn(
        "event_type", F.when(F.col("k") == 98, "INVALID_TYPE").otherwise(F.col("event_type")))
    writers.write_event_lines(sent, path)
    clean = flows.ingest(readers.stream_events_json(spark, path))
    return run_available(clean.select("event_id", "store_id", "event_type", "ts"), "stream-ingest")


@query("stream_quarantine", with_ctes(DAMAGE, EV))
def _(spark, sf):
    feed, root = scratch_path(spark, "damaged-feed"), scratch_path(spark, "stream-quarantine")
    damaged_lines(spark, sf).repartition(4).write.text(feed)
    lines = readers.stream_event_lines(spark, feed, files_per_trigger=1)
    run_batches(lines, batches.wire_handler(root), "stream-quarantine-job")
    return told_apart(spark.read.parquet(f"{root}/events"), spark.read.parquet(f"{root}/quarantine"))


@query("stream_hourly", with_ctes(f"""SELECT store_id, date_trunc('hour', ts) AS hour_bucket, count(DISTINCT session_name) AS active_sessions
  FROM ev WHERE NOT is_staff GROUP BY 1, 2""", EV))
def _(spark, sf):
    out = run_available(flows.hourly(closing_stream(spark, sf), None), "stream-hourly")
    return out.select("store_id", F.col("hour.start").alias("hour_bucket"), "active_sessions")


@query("stream_daily", with_ctes(f"""SELECT store_id, event_date, CAST(sum(n) AS BIGINT) AS session_hours, max(n) AS busiest_hour FROM (
  SELECT store_id, event_date, date_trunc('hour', ts) AS h, count(DISTINCT session_name) AS n FROM ev WHERE NOT is_staff GROUP BY 1, 2, 3)
  GROUP BY 1, 2""", EV))
def _(spark, sf):
    out = run_available(flows.daily(closing_stream(spark, sf), None), "stream-daily")
    return out.select("store_id", F.to_date("day.start").alias("event_date"), "session_hours", "busiest_hour")


@query("stream_sessions", with_ctes(f"""SELECT store_id, visitor_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS events FROM (
  SELECT *, sum(new) OVER (PARTITION BY store_id, visitor_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM (
    SELECT *, CASE WHEN gap IS NULL OR gap >= 1800 THEN 1 ELSE 0 END AS new FROM gaps))
  GROUP BY store_id, visitor_id, n""", EV, GAPS))
def _(spark, sf):
    out = run_available(flows.sessions(closing_stream(spark, sf), delay=None), "stream-sessions")
    return out.select("store_id", "visitor_id", F.col("span.start").alias("start_ts"), "end_ts", "events")


@query("stream_queue", with_ctes("""SELECT store_id, visitor_id, event_id, leave_time AS ts FROM qi
  WHERE abandoned""", EV, GAPS, QUEUE))
def _(spark, sf):
    with rocksdb_state(spark):
        out = run_available(queue.queue_abandons(closing_stream(spark, sf, "10 minutes"), delay=None), "stream-queue")
    return out.select("store_id", "visitor_id", "event_id", F.timestamp_micros("abandon_us").alias("ts"))


SEEN = """seen AS (SELECT store_id, camera_id, user_id AS track_id, event_id AS tracklet_id, ts AS first_ts, ts AS last_ts,
  x1 AS fx1, y1 AS fy1, x1 AS lx1, y1 AS ly1, nm.v FROM ev LEFT JOIN nm ON nm.vec_id = ev.user_id)"""


@query("stream_identity", recursive("SELECT tracklet_id, store_id, visitor_id FROM ident JOIN seen USING (tracklet_id)",
                                    EV, EMB, SEEN, fold_sql("seen"), LINKS, ROOTS))
def _(spark, sf):
    root = scratch_path(spark, "stream-identity")
    vectors = cut_lineage(b.embeddings(spark, sf).repartition("track_id"))  # no row group is larger than a share of them
    for feed in arriving(spark, sf):  # the job is stopped after each part and taken up from its checkpoint
        sightings = identity.as_sightings(b.as_detections(feed), vectors)
        with rocksdb_state(spark):
            out = continue_job(identities.identity_stream(sightings), root)
    return out.where("event = 'seen'").select("tracklet_id", "store_id", identity.visitor_label(F.col("root")).alias("visitor_id"))


@query("stream_dedup_semantic", with_ctes(f"SELECT DISTINCT {SEMKEY} AS dedup_key, event_id FROM replay", EV, REPLAY))
def _(spark, sf):
    path = scratch_path(spark, "replay")
    replayed(spark, sf).select("event_id", "visitor_id", "event_type", "ts").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return run_available(flows.dedup_semantic(stream).select("dedup_key", "event_id"), "stream-dedup")


@query("stream_anomaly", with_ctes("SELECT anomaly_id, store_id, anomaly_type, detected_at, z_score FROM alerts", *BASE, SIG, ALERTS))
def _(spark, sf):
    root = scratch_path(spark, "stream-anomaly")
    handler = batches.anomaly_handler(root, b.purchases_as_transactions, zones=cut_lineage(b.zones(spark, sf)))
    run_parts(interleaved(spark, sf), handler, "stream-anomaly-job")
    return batches.current_alerts(spark, root).select("anomaly_id", "store_id", "anomaly_type", "detected_at", "z_score")


@query("stream_anomaly_kept", rec("""SELECT anomaly_id, store_id, anomaly_type, detected_at, severity, metric_value, z_score, affected_zone_id
  FROM an""", *ANOM))
def _(spark, sf):
    root = scratch_path(spark, "stream-kept")
    handler = batches.anomaly_handler(root, b.purchases_as_transactions, zones=cut_lineage(b.zones(spark, sf)))
    run_batches(b.events_stream(spark, sf), handler, "stream-kept-job")
    return batches.current_anomalies(spark, root).select(
        "anomaly_id", "store_id", "anomaly_type", "detected_at", "severity", "metric_value", "z_score", "affected_zone_id")


@query("stream_freshness", with_ctes(f"""SELECT store_id, max(ts) AS last_event_at,
  {rnd('(epoch_us((SELECT max(ts) FROM ev)) - epoch_us(max(ts))) / CAST(1e6 AS DOUBLE)', 1)} AS lag_seconds FROM ev GROUP BY 1""", EV))
def _(spark, sf):
    root = scratch_path(spark, "stream-freshness")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    run_batches(flows.freshness(b.events_stream(spark, sf)), keep, "stream-freshness-job", mode="update")
    last = spark.read.parquet(root).groupBy("store_id").agg(F.max("last_event_at").alias("last_event_at"))
    lag = seconds_between(d.latest(spark, sf), F.col("last_event_at"))
    return last.select("store_id", "last_event_at", F.round(lag, 1).alias("lag_seconds"))


@query("stream_zone_activity", with_ctes(f"""SELECT store_id, zone_id, span_start, count(*) AS visits FROM (
  SELECT store_id, zone_id, ts, unnest(generate_series(0, 5)) AS i, time_bucket(INTERVAL 5 MINUTE, ts) - i * INTERVAL 5 MINUTE AS span_start
  FROM ev WHERE NOT is_staff AND event_type IN ('ZONE_ENTER', 'ZONE_DWELL')) GROUP BY 1, 2, 3""", EV))
def _(spark, sf):
    out = run_available(flows.zone_activity(closing_stream(spark, sf), None), "stream-zones")
    return out.select("store_id", "zone_id", F.col("span.start").alias("span_start"), "visits")


@query("stream_pos_link", with_ctes(f"""SELECT t.event_id AS tx_id, t.store_id, arg_max({uuid5_sql('e.session_name')}, (e.ts, {uuid5_sql('e.session_name')})) AS session_id, t.ts
  FROM ev t JOIN ev e ON e.store_id = t.store_id AND e.event_type = 'ENTRY' AND NOT e.is_staff AND e.ts <= t.ts AND t.ts <= e.ts + INTERVAL 300 SECOND
  WHERE t.event_type = 'PURCHASE' GROUP BY t.event_id, t.store_id, t.ts""", EV))
def _(spark, sf):
    rows = closing_stream(spark, sf)
    entries = rows.where((F.col("event_type") == "ENTRY") & ~F.col("is_staff")).select(
        "store_id", "session_id", F.col("ts").alias("entry_ts"))
    out = run_available(flows.pos_links(entries, b.purchases_as_transactions(rows), delay=None), "stream-pos")
    return out.select("tx_id", "store_id", "session_id", "ts")


SPLIT = "strftime((SELECT min(ts) FROM ev) + INTERVAL 15 DAY, '%Y-%m-%d')"


@query("late_data", with_ctes(f"""SELECT DISTINCT store_id, date_trunc('hour', ts) AS hour_bucket, event_date FROM ev
  WHERE k = 77 AND event_date < {SPLIT} AND ts < (SELECT max(ts) FROM ev WHERE k <> 77 AND event_date < {SPLIT}) - INTERVAL 2 HOUR""", EV))
def _(spark, sf):
    root = scratch_path(spark, "stream-late")
    ev = b.events(spark, sf).select("event_id", "store_id", "ts", "event_date", "k")
    split = F.date_add(ev.agg(F.to_date(F.min("ts"))).scalar(), 15)
    first = (F.col("event_date") < split) & (F.col("k") != 77)
    run_parts(growing(spark, (ev.where(first), ev.where(~first))), batches.late_handler(root), "stream-late-job")
    late = spark.read.schema(ev.schema).parquet(f"{root}/late")
    return batches.repair_buckets(late)
