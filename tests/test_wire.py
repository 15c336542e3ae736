"""Malformed wire records are kept with a reason; heartbeats close what a paused or ended feed leaves open."""

import json

from pyspark.sql import functions as F

from dwellgrid.plans import load_registry
from dwellgrid.plans.source_queries import damaged_lines
from dwellgrid.session import scratch_path
from dwellgrid.sources import readers
from dwellgrid.streaming import batches, flows, heartbeat
from dwellgrid.streaming.jobs import run_available, run_batches

GOOD = {"event_id": "e1", "store_id": "S", "camera_id": "C", "visitor_id": "V", "event_type": "ENTRY", "timestamp": "2024-05-01T10:00:00+00:00"}


def line(**change):
    return json.dumps({k: v for k, v in {**GOOD, **change}.items() if v is not ...})


LINES = [
    (line(), ""), (line(event_id=...), ""), (line(confidence=0.2, metadata={"a": 1}, zone_id="Z"), ""), (line(metadata='{"a": 1}'), ""),
    (line()[:-7], "unreadable"), (line()[:30], "unreadable"), ("nonsense", "unreadable"), ("[1, 2]", "unreadable"), ('"text"', "unreadable"), ("{}{", "unreadable"), (line() + line(), "unreadable"), (line() + "," + line(), "unreadable"),
    (f"[{line()}]", "unreadable"), (line(confidence="high"), "unreadable"), (line(dwell_ms="x"), "unreadable"), (line(is_staff="maybe"), "unreadable"),
    (line(store_id=...), "store_id"), (line(store_id=""), "store_id"), (line(store_id="s" * 65), "store_id"), (line(visitor_id="v" * 129), "visitor_id"),
    (line(camera_id=None), "camera_id"), (line(confidence=1.01), "confidence"), (line(timestamp="soon"), "timestamp"), (line(timestamp=None), "timestamp"),
    (line(event_type="DANCE"), "event_type"), (line(event_type=...), "event_type"), (line(metadata=[1]), "metadata"), (line(metadata="x"), "metadata"),
    (line(store_id="", confidence=-1, event_type="X"), "store_id,confidence,event_type"), ("{}", "store_id,visitor_id,camera_id,timestamp,event_type"),
]


def test_every_line_is_an_event_or_quarantined(spark):
    texts = [t for t, _ in LINES] + [LINES[4][0], "", "   "]  # a broken line that is sent again is kept again
    checked = readers.checked_lines(spark.createDataFrame([(t,) for t in texts], "value string"))
    good, bad = readers.good_events(checked).collect(), readers.quarantined(checked).collect()
    assert len(good) + len(bad) == len(LINES) + 1 and len(good) == sum(p == "" for _, p in LINES)
    want = sorted([(t, p) for t, p in LINES if p] + [LINES[4]])
    assert sorted((r.raw, ",".join(r.problems)) for r in bad) == want
    assert {r.event_id for r in good} >= {"e1"} and all(r.event_id and r.ts and r.confidence <= 1 for r in good)
    readable = readers.parse_event_lines(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert readable.count() == sum(p != "unreadable" for _, p in LINES)


def test_stream_keeps_what_the_batch_keeps(spark):
    path, root = scratch_path(spark, "wire"), scratch_path(spark, "wire-out")
    rows = spark.createDataFrame([(t,) for t, _ in LINES * 3], "value string")
    rows.repartition(4).write.text(path)
    run_batches(readers.stream_event_lines(spark, path, 1), batches.wire_handler(root), "wire-job")
    bad = spark.read.parquet(f"{root}/quarantine")
    assert bad.select("batch").distinct().count() > 1
    assert sorted((r.raw, ",".join(r.problems)) for r in bad.collect()) == sorted([(t, p) for t, p in LINES if p] * 3)
    assert spark.read.parquet(f"{root}/events").count() == 3 * sum(p == "" for _, p in LINES)
    assert readers.read_events_json(spark, path).count() == 3 * sum(p != "unreadable" for _, p in LINES)


def stream_of(spark, parts):
    """A stream of (store, session, seconds, is_heartbeat) rows, one part per micro-batch, in order."""
    path = scratch_path(spark, "beats")
    for n, part in enumerate(parts):
        rows = spark.createDataFrame(part, "store_id string, session_id string, s long, is_heartbeat boolean")
        rows.select("store_id", "session_id", F.timestamp_seconds("s").alias("ts"), F.lit(False).alias("is_staff"), "is_heartbeat").coalesce(1).write.parquet(f"{path}/{n}")
    schema = spark.read.parquet(f"{path}/0").schema
    return heartbeat.on_feed_clock(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*"))


def hours(out):
    return sorted((r.store_id, int(r.hour.start.timestamp()) // 3600, r.active_sessions) for r in out.collect())


def test_heartbeats_close_windows_and_are_never_counted(spark):
    h = 3600
    data = [[("S", "a", 10, False), ("S", "b", 20, False), ("T", "c", h + 5, False)], [("S", "a", h + 30, False)]]
    open_end = run_available(flows.hourly(stream_of(spark, data), None), "beats-none")
    assert hours(open_end) == []  # the delay of two hours leaves everything open
    closed = run_available(flows.hourly(stream_of(spark, [*data, [("S", None, 9 * h, True)]]), None), "beats-end")
    assert hours(closed) == [("S", 0, 2), ("S", 1, 1), ("T", 1, 1)]
    paused = [*data, [("S", None, 4 * h, True)], [("S", "d", 3 * h, False)]]  # within the delay of the heartbeat: not late
    assert hours(run_available(flows.hourly(stream_of(spark, paused), None), "beats-pause")) == [("S", 0, 2), ("S", 1, 1), ("T", 1, 1)]
    end = paused + [[("S", None, 20 * h, True)]]
    assert hours(run_available(flows.hourly(stream_of(spark, end), None), "beats-more")) == [("S", 0, 2), ("S", 1, 1), ("S", 3, 1), ("T", 1, 1)]


def test_a_table_in_one_file_becomes_lines_in_many_tasks(spark, tmp_path):
    rows = [(i, f"2024-05-01 10:00:{i % 60:02d}", i % 9, "view", 1.5, json.dumps({"k": i % 100})) for i in range(200)]
    shape = "event_id long, ts string, user_id long, event_type string, value double, props string"
    table = spark.createDataFrame(rows, shape).withColumn("ts", F.col("ts").cast("timestamp"))
    table.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = load_registry()[0]["wire_quarantine"](spark, str(tmp_path))
    bad = {89: "metadata", 91: "unreadable", 92: "unreadable", 93: "unreadable", 94: "store_id", 95: "confidence", 96: "event_type", 97: "timestamp"}
    assert {r.event_id: r.problems for r in out.collect()} == {str(i): bad.get(i % 100, "") for i in range(200)}
    assert damaged_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
