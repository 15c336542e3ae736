"""Streams in several micro-batches give the batch result."""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from dwellgrid.operators import anomaly, queueing, rollups, sessions
from dwellgrid.plans import binding as b
from dwellgrid.plans import derived as d
from dwellgrid.plans.stream_queries import interleaved
from dwellgrid.session import scratch_path
from dwellgrid.streaming import batches, flows, queue
from dwellgrid.streaming.jobs import rocksdb_state, run_available, run_batches, run_parts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def feed(spark):
    """The events in three files by day, read one file per micro-batch."""
    root = scratch_path(spark, "feed")
    raw = b.table(spark, SF, "events")
    for i, (low, high) in enumerate((("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-03-01"))):
        part = raw.where((F.col("ts") >= F.lit(low).cast("timestamp")) & (F.col("ts") < F.lit(high).cast("timestamp")))
        part.coalesce(1).write.parquet(f"{root}/{i}")
    return lambda: b.bind_events(
        spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/*"))


@pytest.mark.parametrize("split", ["days", "interleaved"])
def test_anomalies_over_batches(spark, feed, split):
    root = scratch_path(spark, "alerts")
    parts = [feed()] if split == "days" else interleaved(spark, SF)
    run_parts(parts, batches.anomaly_handler(root, b.purchases_as_transactions), "alerts-job")
    columns = ["anomaly_id", "store_id", "detected_at", "anomaly_type", "metric_value", "z_score"]
    got = sorted(map(tuple, batches.current_alerts(spark, root).select(columns).collect()))
    want = anomaly.alerts(anomaly.scored_signals(d.hourly_table(spark, SF))).select(columns)
    assert got == sorted(map(tuple, want.collect())) and got


@pytest.mark.parametrize("split", ["one", "days", "interleaved"])
def test_suppressed_alerts_and_dead_zones_over_batches(spark, feed, split):
    root, zones, ev = scratch_path(spark, "kept"), b.zones(spark, SF), b.events(spark, SF)
    seen, plain = [], batches.anomaly_handler(root, b.purchases_as_transactions, zones=zones)

    def handle(batch, batch_id):
        seen.append({r.event_id for r in batch.select("event_id").collect()})
        plain(batch, batch_id)
        plain(batch, batch_id)

    parts = {"one": lambda: [b.events_stream(spark, SF)], "days": lambda: [feed()], "interleaved": lambda: interleaved(spark, SF)}
    run_parts(parts[split](), handle, "kept-job")
    columns = ["anomaly_id", "store_id", "detected_at", "anomaly_type", "metric_value", "z_score", "affected_zone_id"]
    got = batches.current_anomalies(spark, root).select(columns).collect()
    assert sorted(tuple(r) for r in got if r.anomaly_type != "DEAD_ZONE") == sorted(
        map(tuple, anomaly.suppress_repeats(anomaly.alerts(anomaly.scored_signals(d.hourly_table(spark, SF)))).select(columns).collect()))

    # the dead zones of every batch as of its newest time, without those open since the hour before
    rows, known, stored = ev.collect(), set(), []
    watched = [(z.store_id, z.zone_id) for z in zones.collect() if z.zone_type not in ("ENTRY", "BILLING")]
    for part in seen:
        known |= part
        now = [r for r in rows if r.event_id in known]
        as_of = max(r.ts for r in now)
        since = as_of.replace(minute=0, second=0, microsecond=0) - timedelta(hours=1)
        visits = {}
        for r in now:
            if not r.is_staff and r.event_type in ("ZONE_ENTER", "ZONE_DWELL"):
                visits[r.store_id, r.zone_id] = max(r.ts, visits.get((r.store_id, r.zone_id), r.ts))
        silent = [z for z in watched if z not in visits or as_of - visits[z] > timedelta(minutes=30)]
        stored += [(*z, as_of) for z in silent if not any(s[:2] == z and s[2] >= since for s in stored)]
    assert len(seen) == (1 if split == "one" else 3) and stored
    assert sorted((r.store_id, r.affected_zone_id, r.detected_at) for r in got if r.anomaly_type == "DEAD_ZONE") == sorted(stored)


def test_interleaved_feed_keeps_rows_of_odd_ids(spark, tmp_path):
    raw = b.table(spark, SF, "events").limit(60)
    odd = raw.withColumn("event_id", F.when(F.col("event_id") % 3 == 0, -F.col("event_id")).when(F.col("event_id") % 3 == 1, F.col("event_id")))
    odd.write.parquet(f"{tmp_path}/events.parquet")
    sizes = {}
    run_parts(interleaved(spark, str(tmp_path)), lambda batch, i: sizes.update({i: batch.count()}), "odd-job")
    assert sum(sizes.values()) == 60 and len(sizes) == 3


def test_repeats_are_suppressed_across_batches(spark):
    """Alerts of one store at 22, 23, 0, 1 and 4 o'clock: 22, 1 and 4 stay, whether the days come together or not."""
    from dwellgrid.config import AnomalyConfig

    root, hours = scratch_path(spark, "repeats"), [22, 23, 24, 25, 28]
    rows = spark.createDataFrame([(str(h), h) for h in hours], "anomaly_id string, h int").select(
        "anomaly_id", F.lit("S").alias("store_id"), F.lit("QUEUE_SPIKE").alias("anomaly_type"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600).alias("detected_at"))
    rows = rows.withColumn("event_date", F.to_date("detected_at"))
    first = rows.where(F.col("anomaly_id").cast("int") <= 23)
    for batch_id, (days, known) in enumerate(((first, first), (rows.subtract(first), rows), (first, rows))):
        batches._keep_unrepeated(days.select("event_date").distinct(), known, root, batch_id, AnomalyConfig())
        got = {r.anomaly_id for r in spark.read.parquet(f"{root}/kept").where("anomaly_id IS NOT NULL").collect()}
        assert got == ({"22"} if batch_id == 0 else {"22", "25", "28"})


def test_queue_over_batches(spark, feed):
    with rocksdb_state(spark):
        out = run_available(queue.queue_abandons(feed()), "queue-test")
    end = d.latest(spark, SF) - F.expr("interval 1 day")
    got = {r.event_id for r in out.where(F.timestamp_micros("abandon_us") < end).collect()}
    want = queueing.queue_abandons(queueing.queue_intervals(b.events(spark, SF))).where(F.col("ts") < end)
    assert got == {r.event_id for r in want.collect()} and got


def test_hourly_and_sessions_over_batches(spark, feed):
    day = F.date_trunc("day", d.latest(spark, SF))
    hours = run_available(flows.hourly(feed()), "hours-test").where(F.col("hour.start") < day)
    ev = b.events(spark, SF)
    want = ev.where(~F.col("is_staff") & (F.col("ts") < day)).groupBy("store_id", F.date_trunc("hour", "ts").alias("h")).agg(F.count_distinct("session_id").alias("n"))
    assert sorted(map(tuple, hours.select("store_id", "hour.start", "active_sessions").collect())) == sorted(map(tuple, want.collect()))
    spans = run_available(flows.sessions(feed()), "spans-test").where(F.col("end_ts") < day).select("store_id", "visitor_id", "end_ts", "events")
    closed = sessions.sessions_by_gap(ev).where(F.col("end_ts") < day).select("store_id", "visitor_id", "end_ts", "events")
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, closed.collect()))


def test_replaying_a_batch_changes_nothing(spark):
    root = scratch_path(spark, "late")
    handle = batches.late_handler(root)
    rows = b.events(spark, SF).select("event_id", "store_id", "ts", "event_date")
    early, rest = rows.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")), rows.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    handle(early, 0)
    handle(rest, 1)
    handle(rest, 1)
    late = spark.read.parquet(f"{root}/late")
    assert late.count() == rest.count()
    assert batches.repair_buckets(late).count() == rollups.affected_buckets(rest).count()
