"""Small literal cases for every area."""

import os
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dwellgrid.config import AnomalyConfig, QueueConfig
from dwellgrid.fixed_values import LAYOUT, RECOMMENDED_ACTIONS
from dwellgrid.functions import geometry, hashing, labels, scoring
from dwellgrid.operators import (
    anomaly, evidence, funnel, health, heatmap, identity, insight, kpis, quality, queueing, rollups, sessions, spatial,
    staff, trajectory,
)
from dwellgrid.sources import readers, writers

T0 = datetime(2026, 6, 1, 12, 0, 0)
EVENT = (
    "event_id string, store_id string, visitor_id string, event_type string, ts timestamp, zone_id string, "
    "camera_id string, is_staff boolean, confidence double, metadata_json string"
)


def events(spark, rows):
    """rows: (visitor, type, minutes[, overrides])"""
    data = []
    for i, (visitor, kind, minutes, *more) in enumerate(rows):
        o = more[0] if more else {}
        data.append((o.get("id", f"e{i:04d}"), "S", visitor, kind, T0 + timedelta(minutes=minutes), o.get("zone"),
                     o.get("camera", "CAM_01"), o.get("staff", False), o.get("confidence", 1.0), o.get("meta")))
    df = spark.createDataFrame(data, EVENT).withColumn("event_date", F.to_date("ts"))
    return sessions.with_session_id(df)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def totals(spark, rows):
    return funnel.store_day_funnel(events(spark, rows)).first()


def test_funnel_cases(spark):
    hierarchy = [(f"v{i}", "ENTRY", i) for i in range(20)] + [(f"v{i}", "ZONE_ENTER", 30 + i) for i in range(10)]
    hierarchy += [(f"v{i}", "BILLING_QUEUE_JOIN", 50 + i) for i in range(5)]
    t = totals(spark, hierarchy)
    assert (t.entry_count, t.zone_engagement_count, t.billing_queue_count, t.purchases_count) == (20, 10, 5, 0)
    assert funnel.store_day_funnel(events(spark, [(f"s{i}", "ENTRY", i, {"staff": True}) for i in range(5)])).isEmpty()
    again = totals(spark, [("a", "ENTRY", 0), ("a", "REENTRY", 15)])
    assert (again.unique_visitors, again.reentry_count) == (1, 1)
    only_sales = totals(spark, [(f"v{i}", "PURCHASE", i) for i in range(3)])
    rate = funnel.conversion_rate(F.lit(only_sales.purchases_count), F.lit(only_sales.entry_count))
    assert value(spark, rate) == 0.0


def test_stepwise_journey(spark):
    steps = [("a", "ENTRY", 0), ("a", "ZONE_ENTER", 2), ("a", "BILLING_QUEUE_JOIN", 4), ("a", "PURCHASE", 5)]
    for n in range(1, 5):
        stages = funnel.funnel_stages(funnel.store_day_funnel(events(spark, steps[:n]))).orderBy("stage_order").collect()
        assert [s["count"] for s in stages] == [1] * n + [0] * (4 - n)
        assert [s.rate for s in stages][:n] == [1.0] * n
    checked = funnel.hierarchy_check(funnel.store_day_funnel(events(spark, steps))).first()
    assert checked.hierarchy_ok
    bad = spark.createDataFrame([("S", 1, 2, 0, 0)], "store_id string, entry_count long, zone_engagement_count long, billing_queue_count long, purchases_count long")
    with pytest.raises(Exception, match="Funnel validation failed"):
        funnel.assert_hierarchy(bad).collect()


def test_zero_fill(spark):
    days = funnel.store_day_spine(spark.createDataFrame([("S",), ("EMPTY",)], "store_id string"), F.to_date(F.lit("2026-06-01")), F.to_date(F.lit("2026-06-02")))
    out = funnel.zero_fill(funnel.store_day_funnel(events(spark, [("a", "ENTRY", 0)])), days)
    got = {(r.store_id, str(r.event_date)): r.entry_count for r in out.collect()}
    assert got == {("S", "2026-06-01"): 1, ("S", "2026-06-02"): 0, ("EMPTY", "2026-06-01"): 0, ("EMPTY", "2026-06-02"): 0}


def test_session_ids_and_fold(spark):
    ev = events(spark, [("a", "ENTRY", 0, {"camera": "CAM_01"}), ("a", "ZONE_ENTER", 3, {"camera": "CAM_02", "zone": "Z2"}),
                        ("a", "ZONE_ENTER", 5, {"zone": "Z1"}), ("a", "ZONE_ENTER", 7, {"zone": "Z2"}), ("a", "EXIT", 10)])
    fold = sessions.session_fold(ev).collect()
    assert len(fold) == 1
    assert fold[0].session_id == str(uuid.uuid5(uuid.NAMESPACE_OID, "a:S:2026-06-01:0"))
    assert fold[0].zones_visited == ["Z2", "Z1"] and fold[0].dwell_seconds == 600.0
    open_end = sessions.session_fold(events(spark, [("b", "ENTRY", 0)]))
    as_of = F.lit(str(T0 + timedelta(minutes=4))).cast("timestamp")
    assert sessions.session_dwell(open_end, as_of).first().effective_dwell == 240.0


@pytest.mark.parametrize("history,current,cfg,expected", [
    ([10.0] * 10, 25.0, AnomalyConfig(), None),
    ([10, 12, 9, 11, 10, 13, 8, 11, 10, 12], 20.0, AnomalyConfig(), "high"),
    ([10, 11], 20.0, AnomalyConfig(), None),
    ([10.0], 13.0, AnomalyConfig(min_baseline=1), 3.0),
])
def test_zscore_cases(spark, history, current, cfg, expected):
    df = spark.createDataFrame([(float(x),) for x in history], "x double")
    row = df.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = row.select(scoring.zscore(F.col("n"), F.col("m"), F.col("s"), F.lit(current), cfg).alias("z")).first().z
    assert z > 2.0 if expected == "high" else z == expected


def test_severity_and_confidence(spark):
    for z, name in ((2.6, "MEDIUM"), (2.9, "HIGH"), (3.0, "CRITICAL"), (-3.5, "CRITICAL")):
        assert value(spark, scoring.severity(F.lit(z))) == name
    low = value(spark, scoring.anomaly_confidence(F.lit(3.0), F.lit(3)))
    high = value(spark, scoring.anomaly_confidence(F.lit(4.0), F.lit(14)))
    assert low < 0.5 < high and value(spark, scoring.anomaly_confidence(F.lit(5.0), F.lit(14))) == 1.0


def test_suppression(spark):
    hours = [0, 1, 2, 3, 4, 9, 11, 12, 20]
    found = spark.createDataFrame([("S", "QUEUE_SPIKE", T0 + timedelta(hours=h)) for h in hours], "store_id string, anomaly_type string, detected_at timestamp")
    kept = [int((r.detected_at - T0).total_seconds() // 3600) for r in anomaly.suppress_repeats(found).orderBy("detected_at").collect()]
    assert kept == [0, 3, 9, 12, 20]
    open_alerts = found.limit(1).withColumn("affected_zone_id", F.lit(None).cast("string"))
    left = anomaly.suppress_open(found.withColumn("affected_zone_id", F.lit(None).cast("string")), open_alerts, 7200)
    assert sorted(int((r.detected_at - T0).total_seconds() // 3600) for r in left.collect()) == [3, 4, 9, 11, 12, 20]


def test_dead_zone_and_actions(spark):
    zones = spark.createDataFrame([("S", "Z1", "DISPLAY"), ("S", "Z2", "AISLE"), ("S", "Z3", "DISPLAY"), ("S", "ZB", "BILLING")], "store_id string, zone_id string, zone_type string")
    ev = events(spark, [("a", "ZONE_ENTER", 0, {"zone": "Z1"}), ("a", "ZONE_DWELL", 50, {"zone": "Z2"}), ("s", "ZONE_ENTER", 59, {"zone": "Z1", "staff": True})])
    as_of = F.lit(str(T0 + timedelta(minutes=60))).cast("timestamp")
    rows = {r.affected_zone_id: r for r in anomaly.dead_zone_alerts(anomaly.dead_zones(zones, ev, as_of), as_of).collect()}
    assert {z: r.metric_value for z, r in rows.items()} == {"Z1": 60.0, "Z3": 999.0}
    assert rows["Z1"].severity == "WARN" and rows["Z1"].recommended_action == RECOMMENDED_ACTIONS["DEAD_ZONE"]


def test_quality_rules(spark):
    raw = spark.createDataFrame([
        ("b", "1", "S", "v", "ENTRY", "2026-06-01T12:00:00+05:30", "CAM_01", 0.9),
        ("b", "2", "", "v" * 129, "DANCE", "yesterday", None, 1.2),
    ], "batch_id string, event_id string, store_id string, visitor_id string, event_type string, timestamp string, camera_id string, confidence double")
    rows = {r.event_id: r for r in quality.check_event_type(quality.validate_fields(raw)).collect()}
    assert rows["1"].errors == [] and rows["1"].type_ok
    assert rows["2"].errors == ["store_id", "visitor_id", "camera_id", "confidence", "timestamp"] and not rows["2"].type_ok
    good, bad = quality.split_valid(raw)
    assert good.count() == 1 and bad.count() == 1
    parsed = raw.select(quality.parse_utc(F.col("timestamp")).alias("t")).first().t
    assert parsed == datetime(2026, 6, 1, 6, 30)
    sizes = spark.createDataFrame([("ok", str(i)) for i in range(500)] + [("big", str(i)) for i in range(501)] + [("dup", "1"), ("dup", "1")], "batch_id string, event_id string")
    assert {r.batch_id for r in quality.accepted_batches(sizes).select("batch_id").distinct().collect()} == {"ok"}


def test_dedup_and_metadata(spark):
    ev = events(spark, [("a", "ENTRY", 0, {"id": "2"}), ("a", "ENTRY", 0, {"id": "1"}), ("a", "EXIT", 0), ("b", "ENTRY", 0)])
    assert {r.event_id for r in quality.dedup_semantic(ev).collect()} == {"1", "e0002", "e0003"}
    counts = quality.ingest_counts(ev.limit(1), ev.limit(1)).first()
    assert (counts.ingested, counts.duplicates) == (0, 1)
    assert value(spark, quality.zone_confidence(F.lit(1.0), F.lit("Z"))) == 0.95
    packed = quality.metadata_pack(F.lit(1), F.lit(5), F.lit("Z"), F.lit(None).cast("struct<x1:double>"), F.create_map(F.lit("dwell_seconds"), F.lit("9")))
    assert value(spark, rollups.queue_depth_of(packed)) == 5
    assert value(spark, rollups.dwell_seconds_of(packed)) is None
    assert value(spark, rollups.queue_depth_of(F.lit('{"queue_depth": "many"}'))) is None
    assert value(spark, hashing.track_number(F.lit("CAM_007"))) == "7"
    assert value(spark, hashing.track_number(F.lit("T_" + "9" * 30))) == "9" * 30
    assert 0 <= int(value(spark, hashing.track_number(F.lit("guest")))) < 100000


def box(x1, y1, x2, y2):
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])


def test_boxes_and_zones(spark):
    assert value(spark, geometry.box_iou(box(0, 0, 10, 10), box(20, 20, 30, 30))) == 0.0
    assert value(spark, geometry.box_iou(box(0, 0, 10, 10), box(0, 0, 10, 10))) == 1.0
    plan = [("S", i, z, z, t, p, [[float(a), float(b)] for a, b in poly]) for i, (z, _n, t, p, poly) in enumerate(LAYOUT)]
    plan.append(("S", 90, "POINT", "POINT", "DISPLAY", 99, [[640.0, 200.0]]))
    plan.append(("S", 91, "LOW", "LOW", "DISPLAY", 1, [[200.0, 300.0], [500.0, 300.0], [500.0, 580.0], [200.0, 580.0]]))
    zones = spark.createDataFrame(plan, "store_id string, zone_ord int, zone_id string, zone_name string, zone_type string, priority int, polygon array<array<double>>")
    points = {(100, 650): "ZONE_ENTRY_01", (900, 500): "ZONE_BILLING_01", (350, 450): "ZONE_SKINCARE_01", (750, 150): None, (200, 440): "ZONE_SKINCARE_01"}
    det = spark.createDataFrame([("S", f"{x},{y}", float(x), float(y)) for x, y in points], "store_id string, detection_id string, x double, y double")
    det = det.select("store_id", "detection_id", F.struct((F.col("x") - 5).alias("x1"), (F.col("y") - 9).alias("y1"), (F.col("x") + 5).alias("x2"), F.col("y").alias("y2")).alias("bbox"))
    got = {r.detection_id: r.zone_id for r in spatial.zone_assign(det, zones).collect()}
    assert got == {f"{x},{y}": z for (x, y), z in points.items()}
    triangle = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (100.0, 0.0), (0.0, 100.0))])
    assert value(spark, geometry.in_polygon(F.lit(20.0), F.lit(20.0), triangle))
    assert not value(spark, geometry.in_polygon(F.lit(90.0), F.lit(90.0), triangle))


def test_frame_matching_is_greedy_by_confidence(spark):
    import random
    rng = random.Random(3)
    rows = []
    for frame in range(4):
        for i in range(12):
            x, y = rng.randrange(300), rng.randrange(200)
            rows.append(("S", "C", frame, f"{frame}-{i:02d}", (float(x), float(y), x + 120.0, y + 150.0), round(rng.uniform(0.3, 1), 3)))
    det = spark.createDataFrame(rows, "store_id string, camera_id string, frame_idx long, detection_id string, bbox struct<x1:double,y1:double,x2:double,y2:double>, confidence double")

    def iou(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return w * h / (2 * 120 * 150 - w * h)

    want = {}
    for frame in range(1, 4):
        free = {r[3]: r[4] for r in rows if r[2] == frame - 1}
        for r in sorted((r for r in rows if r[2] == frame), key=lambda r: (r[5] < 0.6, -r[5], r[3])):
            best = min(free, key=lambda p: (-iou(r[4], free[p]), p), default=None)
            if best is not None and iou(r[4], free[best]) >= 0.3:
                want[r[3]] = best
                del free[best]
    assert {r.detection_id: r.prev_id for r in spatial.frame_iou_match(det).collect()} == want


def test_trajectory_events(spark):
    ev = events(spark, [("a", "X", 0, {"zone": "Z1"}), ("a", "X", 2, {"zone": "Z1"}), ("a", "X", 3, {"zone": "Z2"}), ("a", "X", 13), ("a", "X", 58)])
    assert [round(r.gap_seconds) for r in trajectory.reentry_events(ev).collect()] == [600]
    moves = [(r.event_type, r.zone_id) for r in trajectory.zone_transitions(ev).orderBy("ts", F.desc("event_type")).collect()]
    assert moves == [("ZONE_ENTER", "Z1"), ("ZONE_EXIT", "Z1"), ("ZONE_ENTER", "Z2"), ("ZONE_EXIT", "Z2")]
    assert [(r.zone_id, r.dwell_seconds) for r in trajectory.zone_dwell_on_exit(ev).orderBy("enter_ts").collect()] == [("Z1", 180.0), ("Z2", 600.0)]
    seq = [(r.visit_no, r.sequence_number) for r in trajectory.session_sequence(ev).orderBy("ts").collect()]
    assert seq == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)]
    zones = spark.createDataFrame([("S", "Z2", "BILLING")], "store_id string, zone_id string, zone_type string")
    assert trajectory.purchase_on_billing_exit(ev, zones).isEmpty()
    assert trajectory.purchase_on_billing_exit(ev, zones, strict_types=False).count() == 1


def test_queue(spark):
    rows = [(v, "BILLING_QUEUE_JOIN", i / 4) for i, v in enumerate("abcde")] + [("a", "PURCHASE", 3), ("b", "EXIT", 1.5), ("c", "EXIT", 9)]
    stays = queueing.queue_intervals(events(spark, rows))
    assert {r.visitor_id for r in queueing.queue_abandons(stays).collect()} == {"c", "d", "e"}
    joins = {r.visitor_id: r.queue_depth for r in queueing.queue_joins(queueing.queue_depth(stays)).collect()}
    assert joins == {"d": 4, "e": 5}
    snap = queueing.queue_snapshot(stays, F.lit(str(T0 + timedelta(minutes=2.2))).cast("timestamp"), QueueConfig(density_threshold=4)).collect()
    assert {r.visitor_id for r in snap} == {"a", "c", "d", "e"} and snap[0].queue_depth == 4 and snap[0].is_active


def test_hot_keys_give_the_same_queue(tiny_groups):
    rows = [(f"v{i % 7}", "BILLING_QUEUE_JOIN" if i % 3 else "EXIT", i * 0.7) for i in range(40)]
    spread = sorted(map(tuple, queueing.queue_depth(queueing.queue_intervals(events(tiny_groups, rows))).collect()))
    tiny_groups.conf.unset("dwellgrid.maxGroupRows")
    plain = sorted(map(tuple, queueing.queue_depth(queueing.queue_intervals(events(tiny_groups, rows))).collect()))
    assert spread == plain


def test_staff(spark):
    rows = [("w", "ZONE_DWELL", d * 1440 + h * 60, {"zone": f"Z{(d + h) % 6}", "meta": '{"dwell_seconds": 1800}'}) for d in range(6) for h in (-3, 9)]
    rows += [("c", "ZONE_DWELL", 0, {"zone": "Z1", "meta": '{"dwell_seconds": 60}'})]
    ev = events(spark, rows)
    scores = staff.staff_scores(staff.visitor_profile(ev, rollups.dwell_seconds_of(F.col("metadata_json"))))
    assert {r.visitor_id for r in staff.staff_members(scores).collect()} == {"w"}
    marked = staff.mark_staff(ev, staff.staff_members(scores))
    assert marked.where("is_staff").count() == 12


def test_identity_cases(spark):
    decay = [value(spark, scoring.temporal_score(F.lit(m * 60.0))) for m in (2, 15, 29, 31)]
    assert decay[0] > decay[1] > decay[2] > 0 and decay[3] == 0
    same = (0.0, 0.0, 100.0, 200.0)
    far = (900.0, 0.0, 1000.0, 200.0)
    rows = [("S", "C1", i + 1, 0, f"t{i}", T0 + timedelta(seconds=s), T0 + timedelta(seconds=s), b, b, None)
            for i, (s, b) in enumerate([(0, same), (2, same), (4, far), (6, same)])]
    trk = spark.createDataFrame(rows, "store_id string, camera_id string, track_id long, frame_idx long, tracklet_id string, first_ts timestamp, last_ts timestamp, "
                                "first_bbox struct<x1:double,y1:double,x2:double,y2:double>, last_bbox struct<x1:double,y1:double,x2:double,y2:double>, embedding array<double>")
    ids = {r.tracklet_id: r.visitor_id for r in identity.resolve(identity.identity_links(trk)).collect()}
    assert ids["t0"] == ids["t1"] == ids["t3"] != ids["t2"]
    stats = identity.reid_stats(identity.identity_links(trk)).first()
    assert (stats.calls, stats.merges, stats.merge_rate, stats.identities) == (4, 2, 0.5, 2)
    parents = {r.tracklet_id: r.parent_id for r in identity.best_candidates(identity.identity_links(trk)).collect()}
    assert parents == {"t1": "t0", "t3": "t0"}


def test_reentry_opens_a_session(spark):
    at = [0, 3, 10, 39, 69, 100, 1450]  # minutes: 3 and 100 are no re-entry, 1450 is another day
    ev = events(spark, [("v", "ENTRY" if m == 0 else "EXIT" if m == 3 else "ZONE_ENTER", m) for m in at] + [("w", "ENTRY", 10)])
    told = sessions.with_visit_sessions(ev)
    visits = {(r.visitor_id, r.ts): (r.visit_no, r.session_id) for r in told.collect()}
    mine = [visits["v", T0 + timedelta(minutes=m)] for m in at]
    assert [n for n, _ in mine] == [0, 0, 1, 2, 3, 3, 3]
    ids = [i for _, i in mine]
    assert ids[0] == ids[1] and ids[4] == ids[5] and len(set(ids)) == 5
    assert ids[0] == sessions.with_session_id(ev).where("visitor_id = 'v'").orderBy("ts").first().session_id
    folded = {r.session_id: r for r in sessions.session_fold(told).collect()}
    assert len(folded) == 6 and folded[ids[0]].exit_time is not None and folded[ids[2]].exit_time is None


def test_sketched_visitors_stay_within_their_error(spark):
    hours = spark.range(200_000).select(
        F.lit("S").alias("store_id"), (F.col("id") * 7919 % 60_000).cast("string").alias("visitor_id"), F.lit(False).alias("is_staff"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 24 * 3600).alias("ts"))
    sketches = rollups.visitor_sketches(hours)
    exact = hours.select("visitor_id").distinct().count()
    got = rollups.distinct_visitors(sketches).first()
    assert got.events == 200_000 and abs(got.visitors - exact) <= 4 * 1.04 / 2 ** 7 * exact
    assert rollups.distinct_visitors(sketches, F.to_date("hour_bucket").alias("day")).count() == 1


def test_total_levels_expand_once(spark):
    rows = spark.createDataFrame([("S", "a", 1.5), ("S", "a", None), ("T", "b", 2.0)], "store_id string, visitor_id string, value double").select(
        "*", F.lit("PURCHASE").alias("event_type"), F.lit(False).alias("is_staff"), F.lit(T0).alias("ts"), F.to_date(F.lit(T0)).alias("event_date"))
    out = rollups.total_levels(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1
    assert {(r.level, r.store_id): (r.events, r.visitors, r.revenue) for r in out.collect() if r.level in ("store", "chain")} == {
        ("store", "S"): (2, 1, 1.5), ("store", "T"): (1, 1, 2.0), ("chain", None): (3, 2, 3.5)}


def test_heatmap_and_kpis(spark):
    zones = spark.createDataFrame([("S", "Z1", "One", "DISPLAY"), ("S", "Z2", "Two", "AISLE"), ("S", "Z3", "Three", "AISLE")], "store_id string, zone_id string, zone_name string, zone_type string")
    ev = events(spark, [("a", "ZONE_ENTER", 0, {"zone": "Z1"}), ("a", "ZONE_DWELL", 2, {"zone": "Z1", "meta": '{"dwell_seconds": 100}'}),
                        ("a", "ZONE_ENTER", 3, {"zone": "Z2"}), ("a", "EXIT", 4)])
    rows = {r.zone_id: r for r in heatmap.zone_heatmap(zones, ev).collect()}
    assert (rows["Z1"].avg_dwell_seconds, rows["Z2"].avg_dwell_seconds, rows["Z3"].avg_dwell_seconds) == (100.0, 60.0, 0.0)
    assert rows["Z1"].intensity == round(100 / 240, 4) and rows["Z2"].data_source == "fallback"
    assert heatmap.zone_heatmap(zones.limit(0), ev).isEmpty()
    report = kpis.event_stream_report(ev).first()
    assert report.entrance.exit_count == 1 and report.entrance.current_occupancy == 0 and report.reid.total_visitors == 1


def test_health_and_labels(spark):
    stores = spark.createDataFrame([("S",), ("QUIET",)], "store_id string")
    fresh = health.feed_freshness(stores, events(spark, [("a", "ENTRY", 0)]), F.lit(str(T0 + timedelta(seconds=90))).cast("timestamp"))
    got = {r.store_id: (r.lag_seconds, r.stale_feed) for r in fresh.collect()}
    assert got == {"S": (90.0, False), "QUIET": (None, True)}
    assert health.feed_status(fresh).first().status == "degraded"
    for seconds, text in ((None, "No events"), (30.0, "30s ago"), (90.0, "2m ago"), (7200.0, "2h ago")):
        assert value(spark, labels.lag_label(F.lit(seconds).cast("double"))) == text
    assert value(spark, labels.stage_label(F.lit("BILLING_ZONE_REACHED"))) == "Billing Zone"
    assert value(spark, labels.stage_label(F.lit("some_stage"))) == "Some Stage"


def test_answers(spark):
    daily = spark.createDataFrame([("S", T0.date(), 10, 4, 40.0, 3.5, 13, 2, 7, 99.0)], "store_id string, event_date date, unique_visitors long, conversions long, "
                                  "conversion_rate_pct double, avg_dwell_minutes double, peak_hour int, max_queue_depth int, abandonment_count long, total_revenue double")
    hourly = evidence.evidence_hourly(spark.createDataFrame([("S", T0, 10, 4, 2)], "store_id string, hour_bucket timestamp, unique_visitors long, conversions long, max_queue_depth int"))
    alerts = spark.createDataFrame([], "store_id string, rank int, anomaly_type string, severity string, metric_value double, baseline_value double, z_score double")
    counts = evidence.evidence_funnel(events(spark, [("a", "ENTRY", 0)]))
    texts = [(0, "Any problem today?"), (1, "Why is conversion low?"), (2, "How many people came?"), (3, "Hello")]
    asked = spark.createDataFrame(texts, "qid int, text string").select(
        "qid", evidence.question_intent(F.col("text")).alias("intent"), F.lit("S").alias("store_id"), F.lit(T0.date()).alias("event_date"))
    bundled = evidence.bundle(daily, hourly, alerts, counts)
    out = {r.qid: r for r in evidence.cap_confidence(evidence.rule_answers(asked, bundled)).collect()}
    assert [out[i].intent for i in range(4)] == ["anomaly", "conversion", "traffic", "general"]
    assert "High queue abandonment (7 checkouts abandoned)" in out[1].conclusion
    assert out[2].observations == ["Total unique visitors today: 10.", "Average customer dwell time: 3.5 minutes.", "Traffic peaked during hour 13:00."]
    assert out[0].confidence == 0.85 and not out[0].insufficient_data and out[0].data_coverage == 3
    nothing = evidence.cap_confidence(evidence.rule_answers(asked.withColumn("store_id", F.lit("X")), bundled)).first()
    assert nothing.confidence == 0.0 and nothing.insufficient_data


def test_insight(spark):
    stages = funnel.funnel_stages(spark.createDataFrame([("S", T0.date(), 100, 50, 40, 10)], "store_id string, event_date date, entry_count long, zone_engagement_count long, billing_queue_count long, purchases_count long"))
    rich = insight.funnel_rich(stages)
    assert [r.status for r in insight.stage_status(rich).orderBy("stage_order").collect()] == ["healthy", "attention", "attention", "watch"]
    kpi = insight.funnel_kpis(rich).first()
    assert (kpi.critical_stage, kpi.revenue, kpi.lost_revenue) == ("ENGAGEMENT", 16500.0, 51975)


def test_sources_and_merges(spark, tmp_path):
    lines = tmp_path / "events.jsonl"
    lines.write_text('{"store_id": "S", "visitor_id": "v", "event_type": "ENTRY", "timestamp": "2026-06-01T12:00:00+00:00", "camera_id": "C"}\n')
    row = readers.read_events_json(spark, str(lines)).first()
    assert (row.dwell_ms, row.is_staff, row.confidence, row.ts) == (0, False, 1.0, T0) and len(row.event_id) == 36
    csv = tmp_path / "pos.csv"
    csv.write_text("tx_id,amount,timestamp,pos_terminal_id\nt1,9.5,2026-06-01T12:00:00+00:00,POS_01\n,,2026-06-01T12:01:00+00:00,POS_02\n")
    tx = readers.read_pos_csv(spark, str(csv), F.lit("S")).orderBy("ts").collect()
    assert (tx[0].tx_id, tx[0].amount, tx[1].amount) == ("t1", 9.5, 0.0) and len(tx[1].tx_id) == 36
    layout = tmp_path / "layout.json"
    layout.write_text('{"stores": [{"store_id": "S", "name": "n", "zones": [{"zone_id": "Z", "name": "z", "zone_type": "DISPLAY", "polygon": [[0, 0], [1, 0], [1, 1]]}]}, {"store_id": "T", "zones": []}]}')
    zones = readers.read_layout(spark, str(layout), "S").collect()
    assert [(z.zone_id, z.priority) for z in zones] == [("Z", 0)]
    old = spark.createDataFrame([("k", 1), ("l", 1)], "id string, v int")
    new = spark.createDataFrame([("k", 2), ("m", 2), ("m", 3)], "id string, v int")
    assert sorted(map(tuple, writers.insert_ignore(old, new, "id", ["v"]).collect())) == [("k", 1), ("l", 1), ("m", 2)]
    assert sorted(map(tuple, writers.replace_rows(old, new.limit(1), ["id"]).collect())) == [("k", 2), ("l", 1)]




def test_long_conflict_chain_is_settled_in_one_pass(spark):
    """Chooser i wants item i - 1 first and item i second; every choice waits for the one before."""
    from dwellgrid.operators.matching import priority_match

    n = 200
    rows = [("f", i, i - 1, 0, 0.5) for i in range(1, n)] + [("f", i, i, 1, 0.4) for i in range(n)]
    rows += [("g", 1000 + i, i, 0, 0.9) for i in range(3)]
    pairs = spark.createDataFrame(rows, "frame string, c int, item int, wish int, iou double")
    got = {(r.c, r.item) for r in priority_match(pairs, ["frame"], "c", "item", ["c", "wish"], ["iou"]).collect()}
    assert got == {(i, i) for i in range(n)} | {(1000 + i, i) for i in range(3)}


@pytest.mark.parametrize("kind", ["random", "chain", "dense"])
def test_crowded_groups_are_never_one_table(tiny_groups, monkeypatch, kind):
    """Groups above the bound give the serial result, and no task gets the pairs of one as a table."""
    import random

    from dwellgrid.operators import matching

    rng, n = random.Random(5), 40
    rows = {
        "random": [("f", c, i, rng.choice([None, 0.1, 0.2, 0.3]), 0.5) for c in range(n) for i in rng.sample(range(n), 4)],
        "chain": [("f", i, i - 1, 0.0, 0.5) for i in range(1, n)] + [("f", i, i, 1.0, 0.4) for i in range(n)],
        "dense": [(f, c, i, float((c * i) % 7), 0.5) for f in ("f", "g") for c in range(20) for i in range(20)],
    }[kind] + [("small", 1, 2, 0.0, 0.3)]
    pairs = tiny_groups.createDataFrame(rows, "frame string, c int, item int, wish double, iou double")
    asked = []
    inner = matching._by_size
    monkeypatch.setattr(matching, "_by_size", lambda *a: asked.append(inner(*a)) or asked[-1])
    got = sorted((r.c, r.item) for r in matching.priority_match(pairs, ["frame"], "c", "item", ["c", "wish"], ["iou"]).collect())
    want, chosen, taken = [], set(), set()
    for f, c, i, wish, _ in sorted(rows, key=lambda r: (r[0], r[1], r[3] is None, r[3] or 0.0, r[2])):
        if (f, c) not in chosen and (f, i) not in taken:
            chosen.add((f, c))
            taken.add((f, i))
            want.append((c, i))
    assert got == sorted(want)
    assert 2 <= len(asked) <= 10  # rounds stay logarithmic
    assert all(r["count"] <= 3 for fits, _ in asked for r in fits.groupBy("frame").count().collect())


def test_stages_are_dropped(spark, tmp_path):
    from dwellgrid.session import cut_lineage, drop_stages

    df = cut_lineage(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    assert drop_stages(spark) >= 1 and not os.path.exists(path) and drop_stages(spark) == 0


def test_upserts_leave_other_partitions_alone(spark, tmp_path):
    from dwellgrid.sources import writers

    path = str(tmp_path / "hours")
    old = spark.createDataFrame([("s", 1, "2026-01-01", 1), ("s", 2, "2026-01-02", 2)], "store string, hour int, event_date string, n int")
    writers.overwrite_partitions(old, path, "event_date")
    before = sorted(os.listdir(f"{path}/event_date=2026-01-01"))
    writers.upsert_rows_into(path, old.where("hour = 2").withColumn("n", F.lit(9)), ["store", "hour"])
    stored = spark.read.schema(old.schema).parquet(path)
    assert sorted((r.hour, r.n) for r in stored.collect()) == [(1, 1), (2, 9)]
    assert sorted(os.listdir(f"{path}/event_date=2026-01-01")) == before
