"""Registered queries: zones, boxes, tracks, trajectory events, queue and staff."""

from pyspark.sql import functions as F

from dwellgrid.config import QueueConfig
from dwellgrid.fixed_values import LAYOUT
from dwellgrid.operators import queueing, rollups, spatial, staff, tracking, trajectory
from dwellgrid.plans import binding as b
from dwellgrid.plans.binding import EV, ZN, rnd, with_ctes, xsum
from dwellgrid.plans.registry import query


@query("foot_point", with_ctes("SELECT event_id AS detection_id, (x1 + x2) / 2 AS foot_x, y2 AS foot_y FROM ev", EV))
def _(spark, sf):
    return spatial.with_foot_point(b.detections(spark, sf)).select("detection_id", "foot_x", "foot_y")


_rects = ", ".join(
    f"({i}, '{z}', {p}, {poly[0][0]}, {poly[0][1]}, {poly[2][0]}, {poly[2][1]})" for i, (z, _n, _t, p, poly) in enumerate(LAYOUT)
)


@query("zone_assign", with_ctes(f"""SELECT f.detection_id, arg_min(zone_id, (-priority, zone_ord)) AS zone_id
  FROM (SELECT event_id AS detection_id, (x1 + x2) / 2 AS x, y2 AS y FROM ev) f
  LEFT JOIN (VALUES {_rects}) r(zone_ord, zone_id, priority, ax, ay, bx, b_y)
  ON sqrt(pow(greatest(ax - x, 0, x - bx), 2) + pow(greatest(ay - y, 0, y - b_y), 2)) < 1
  GROUP BY 1""", EV))
def _(spark, sf):
    out = spatial.zone_assign(b.detections(spark, sf), b.zones(spark, sf, layout=True))
    return out.select("detection_id", "zone_id")


@query("zones_by_type", with_ctes(
    "SELECT store_id, zone_type, zone_id, priority FROM zn WHERE zone_type IN ('BILLING', 'ENTRY', 'EXIT')", EV, ZN))
def _(spark, sf):
    return spatial.zones_of_type(b.zones(spark, sf), "BILLING", "ENTRY", "EXIT").select(
        "store_id", "zone_type", "zone_id", "priority")


PREV = """pv AS (SELECT store_id, camera_id, user_id AS track_id, ts, event_id AS detection_id, x1, y1, x2, y2,
  lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2
  FROM ev WINDOW w AS (PARTITION BY store_id, camera_id, user_id ORDER BY ts, event_id)),
inter AS (SELECT *, greatest(0, least(x2, px2) - greatest(x1, px1)) * greatest(0, least(y2, py2) - greatest(y1, py1)) AS i FROM pv)"""


@query("bbox_iou", with_ctes(f"""SELECT detection_id, {rnd('CASE WHEN i > 0 THEN i / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - i) ELSE 0 END', 6)} AS iou
  FROM inter WHERE px1 IS NOT NULL""", EV, PREV))
def _(spark, sf):
    return spatial.consecutive_iou(b.detections(spark, sf)).select("detection_id", F.round("iou", 6).alias("iou"))


TRACKS = """cf AS (SELECT store_id, camera_id, epoch_us(ts) // 60000000 AS fr, event_id, x1, y1,
  CAST(0.35 AS DOUBLE) + CAST(k AS DOUBLE) / 100 * CAST(0.45 AS DOUBLE) AS confidence FROM ev),
turns AS (SELECT *, confidence >= CAST(0.6 AS DOUBLE) AS sure, row_number() OVER (PARTITION BY store_id, camera_id
  ORDER BY fr, confidence < CAST(0.6 AS DOUBLE), CASE WHEN confidence >= CAST(0.6 AS DOUBLE) THEN -confidence END, event_id) AS rn FROM cf),
live AS (
  SELECT DISTINCT store_id, camera_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS fr, CAST(NULL AS VARCHAR) AS event_id,
    CAST(NULL AS VARCHAR) AS root, CAST(NULL AS VARCHAR) AS how, CAST(NULL AS DOUBLE) AS iou,
    CAST([] AS STRUCT(root VARCHAR, hits BIGINT, last BIGINT, m BIGINT, x DOUBLE, y DOUBLE)[]) AS st FROM cf
  UNION ALL
  SELECT store_id, camera_id, rn, fr, event_id, found, how, CASE WHEN how = 'matched' THEN best.iou END,
    list_concat(list_transform(st, lambda t: CASE WHEN how <> 'matched' OR t.root <> found THEN t
        ELSE struct_pack(root := t.root, hits := t.hits + 1, last := fr, m := fr, x := x1, y := y1) END),
      CASE WHEN how = 'opened' THEN [struct_pack(root := event_id, hits := CAST(1 AS BIGINT), last := fr, m := CAST(-1 AS BIGINT), x := x1, y := y1)] ELSE [] END)
  FROM (
    SELECT *, CASE WHEN best.iou >= CAST(0.3 AS DOUBLE) THEN best.root WHEN sure THEN event_id END AS found,
      CASE WHEN best.iou >= CAST(0.3 AS DOUBLE) THEN 'matched' WHEN sure THEN 'opened' ELSE 'discarded' END AS how
    FROM (
      SELECT *, list_filter(free, lambda t: t.iou = list_max(list_transform(free, lambda u: u.iou)))[1] AS best FROM (
        SELECT *, list_transform(list_filter(st, lambda t: t.m <> fr AND (sure OR (t.hits >= 5 AND fr - 1 > t.last))),
          lambda t: struct_pack(root := t.root, iou := greatest(0, 100 - abs(x1 - t.x)) * greatest(0, 200 - abs(y1 - t.y))
            / (40000 - greatest(0, 100 - abs(x1 - t.x)) * greatest(0, 200 - abs(y1 - t.y))))) AS free
        FROM (
          SELECT d.*, list_filter(l.st, lambda t: d.fr - 1 - t.last <= 90) AS st
          FROM live l JOIN turns d ON d.store_id = l.store_id AND d.camera_id = l.camera_id AND d.rn = l.rn + 1))))),
named AS (SELECT *, row_number() OVER (PARTITION BY store_id, camera_id ORDER BY rn) AS track_id FROM live WHERE how = 'opened')"""


def tracks_sql(body: str) -> str:
    return with_ctes(body, EV, TRACKS).replace("WITH ", "WITH RECURSIVE ", 1)


@query("frame_iou_match", tracks_sql(f"""SELECT l.event_id AS detection_id, n.track_id, l.how, {rnd('l.iou', 6)} AS iou
  FROM live l LEFT JOIN named n ON n.store_id = l.store_id AND n.camera_id = l.camera_id AND n.root = l.root WHERE l.rn > 0"""))
def _(spark, sf):
    out = tracking.track_detections(b.camera_frames(spark, sf))
    return out.select("detection_id", "track_id", "how", F.round("iou", 6).alias("iou"))


@query("live_track_states", tracks_sql(f"""SELECT store_id, camera_id, track_id, first_frame, last_frame, hits, avg_confidence,
  CASE WHEN feed - last_frame > 90 THEN 'DELETED' WHEN hits >= 5 AND feed > last_frame THEN 'LOST' WHEN hits >= 5 THEN 'CONFIRMED'
    ELSE 'TENTATIVE' END AS state FROM (
  SELECT l.store_id, l.camera_id, n.track_id, min(l.fr) AS first_frame, max(l.fr) AS last_frame, count(*) AS hits,
    {rnd(xsum('c.confidence') + ' / count(*)', 6)} AS avg_confidence
  FROM live l JOIN named n ON n.store_id = l.store_id AND n.camera_id = l.camera_id AND n.root = l.root JOIN cf c ON c.event_id = l.event_id
  GROUP BY 1, 2, 3) JOIN (SELECT store_id, camera_id, max(fr) AS feed FROM cf GROUP BY 1, 2) USING (store_id, camera_id)"""))
def _(spark, sf):
    frames = b.camera_frames(spark, sf)
    out = tracking.track_table(tracking.track_detections(frames), frames)
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("predict_position", with_ctes("""SELECT detection_id, coalesce(x1 + (x1 - px1), x1) AS x1, coalesce(y1 + (y1 - py1), y1) AS y1,
  coalesce(x2 + (x1 - px1), x2) AS x2, coalesce(y2 + (y1 - py1), y2) AS y2 FROM pv""", EV, PREV))
def _(spark, sf):
    return spatial.predict_position(b.detections(spark, sf)).select("detection_id", "predicted.*")


@query("track_summary", with_ctes(f"""SELECT store_id, camera_id, user_id AS track_id, min(ts) AS first_ts, max(ts) AS last_ts,
  count(*) AS hits, {rnd(xsum('confidence') + ' / count(*)', 6)} AS avg_confidence, arg_max(y1, ts) AS last_y1 FROM ev GROUP BY 1, 2, 3""", EV))
def _(spark, sf):
    out = spatial.track_summary(b.detections(spark, sf))
    return out.select("store_id", "camera_id", "track_id", "first_ts", "last_ts", "hits",
                      F.round("avg_confidence", 6).alias("avg_confidence"), F.col("last_bbox.y1").alias("last_y1"))


@query("track_state", with_ctes("""SELECT store_id, camera_id, track_id, generation, hits, last_frame,
  CASE WHEN feed - last_frame > 90 THEN 'DELETED' WHEN hits >= 5 AND feed > last_frame THEN 'LOST' WHEN hits >= 5 THEN 'CONFIRMED'
    ELSE 'TENTATIVE' END AS state FROM (
  SELECT store_id, camera_id, track_id, CAST(generation AS BIGINT) AS generation, count(*) AS hits, max(fr) AS last_frame FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY store_id, camera_id, track_id ORDER BY fr, event_id ROWS UNBOUNDED PRECEDING) AS generation FROM (
      SELECT store_id, camera_id, user_id AS track_id, event_id, epoch_us(ts) // 3600000000 AS fr,
        CASE WHEN lag(epoch_us(ts) // 3600000000) OVER w IS NULL OR epoch_us(ts) // 3600000000 - lag(epoch_us(ts) // 3600000000) OVER w > 90
          THEN 1 ELSE 0 END AS fresh
      FROM ev WINDOW w AS (PARTITION BY store_id, camera_id, user_id ORDER BY epoch_us(ts) // 3600000000, event_id)))
  GROUP BY 1, 2, 3, 4) JOIN (SELECT store_id, camera_id, max(epoch_us(ts) // 3600000000) AS feed FROM ev GROUP BY 1, 2) USING (store_id, camera_id)""", EV))
def _(spark, sf):
    return spatial.track_state(b.detections(spark, sf))


@query("track_history30", with_ctes("""SELECT store_id, camera_id, user_id AS track_id, count(*) AS kept,
  string_agg(event_id, ',' ORDER BY ts, event_id) AS detections FROM (SELECT *, row_number() OVER (
    PARTITION BY store_id, camera_id, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev) WHERE rn <= 30 GROUP BY 1, 2, 3""", EV))
def _(spark, sf):
    ids = F.transform("history", lambda h: h["detection_id"])
    return spatial.track_history(b.detections(spark, sf)).select(
        "store_id", "camera_id", "track_id", F.size("history").cast("long").alias("kept"), F.array_join(ids, ",").alias("detections"))


@query("entry_events", with_ctes("""SELECT store_id, visitor_id, 'ENTRY' AS event_type, min(ts) AS ts,
  arg_min(event_id, ts) AS event_id, arg_min(camera_id, ts) AS camera_id FROM ev GROUP BY 1, 2""", EV))
def _(spark, sf):
    return trajectory.entry_events(b.events(spark, sf))


GAPS = """gaps AS (SELECT store_id, visitor_id, ts, event_id, event_type, zone_id,
  (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / CAST(1e6 AS DOUBLE) AS gap, lag(zone_id) OVER w AS prev_zone,
  lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type
  FROM ev WINDOW w AS (PARTITION BY store_id, visitor_id ORDER BY ts, event_id))"""


@query("reentry_events", with_ctes("""SELECT store_id, visitor_id, 'REENTRY' AS event_type, ts, event_id, gap AS gap_seconds
  FROM gaps WHERE gap BETWEEN 300 AND 1800""", EV, GAPS))
def _(spark, sf):
    return trajectory.reentry_events(b.events(spark, sf))


@query("session_sequence", with_ctes("""SELECT store_id, visitor_id, ts, event_id, visit_no,
  row_number() OVER (PARTITION BY store_id, visitor_id, visit_no ORDER BY ts, event_id) AS sequence_number FROM (
    SELECT *, CAST(sum(CASE WHEN gap BETWEEN 300 AND 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY store_id, visitor_id
      ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit_no FROM gaps)""", EV, GAPS))
def _(spark, sf):
    return trajectory.session_sequence(b.events(spark, sf))


TRANS = """chg AS (SELECT *, lead(ts) OVER (PARTITION BY store_id, visitor_id ORDER BY ts, event_id) AS exit_ts
  FROM gaps WHERE zone_id IS DISTINCT FROM prev_zone),
trans AS (SELECT store_id, visitor_id, ts, event_id, 'ZONE_EXIT' AS event_type, prev_zone AS zone_id FROM chg WHERE prev_zone IS NOT NULL
  UNION ALL SELECT store_id, visitor_id, ts, event_id, 'ZONE_ENTER', zone_id FROM chg WHERE zone_id IS NOT NULL)"""


@query("zone_transitions", with_ctes("SELECT * FROM trans", EV, GAPS, TRANS))
def _(spark, sf):
    return trajectory.zone_transitions(b.events(spark, sf))


@query("zone_dwell_on_exit", with_ctes("""SELECT * FROM (SELECT store_id, visitor_id, zone_id, ts AS enter_ts, exit_ts,
  (epoch_us(exit_ts) - epoch_us(ts)) / CAST(1e6 AS DOUBLE) AS dwell_seconds FROM chg
  WHERE zone_id IS NOT NULL AND exit_ts IS NOT NULL) WHERE dwell_seconds > 5""", EV, GAPS, TRANS))
def _(spark, sf):
    return trajectory.zone_dwell_on_exit(b.events(spark, sf))


@query("exit_at_feed_end", with_ctes("""SELECT store_id, visitor_id, 'EXIT' AS event_type, e.ts, CAST(0.8 AS DOUBLE) AS confidence,
  'video_end' AS reason FROM (SELECT store_id, visitor_id, arg_max(event_type, ts) AS last_type FROM ev GROUP BY 1, 2)
  JOIN (SELECT store_id, max(ts) AS ts FROM ev GROUP BY 1) e USING (store_id) WHERE last_type <> 'EXIT'""", EV))
def _(spark, sf):
    return trajectory.exit_at_feed_end(b.events(spark, sf))


@query("purchase_on_billing_exit", with_ctes("""SELECT store_id, zone_id, visitor_id, ts, event_id, 'PURCHASE' AS event_type
  FROM trans WHERE event_type = 'ZONE_EXIT' AND zone_id = 'Z_BILLING'""", EV, GAPS, TRANS))
def _(spark, sf):
    return trajectory.purchase_on_billing_exit(b.events(spark, sf), b.zones(spark, sf), strict_types=False)


QUEUE = """qi AS (SELECT store_id, visitor_id, zone_id, event_id, join_time, transacted, abandoned,
  CASE WHEN abandoned THEN lim ELSE next_ts END AS leave_time FROM (
    SELECT *, NOT transacted AND (next_ts IS NULL OR next_ts >= lim) AS abandoned FROM (
      SELECT *, ts AS join_time, coalesce(next_type = 'PURCHASE', false) AS transacted, ts + INTERVAL 120 SECOND AS lim
      FROM gaps WHERE event_type = 'BILLING_QUEUE_JOIN'))),
qd AS (SELECT store_id, visitor_id, event_id, ts, delta, CAST(sum(delta) OVER (PARTITION BY store_id
  ORDER BY ts, delta, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM (
    SELECT store_id, visitor_id, event_id, join_time AS ts, 1 AS delta FROM qi
    UNION ALL SELECT store_id, visitor_id, event_id, leave_time, -1 FROM qi WHERE leave_time IS NOT NULL))"""


def intervals(spark, sf):
    return queueing.queue_intervals(b.events(spark, sf))


@query("queue_depth", with_ctes("SELECT * FROM qd", EV, GAPS, QUEUE))
def _(spark, sf):
    return queueing.queue_depth(intervals(spark, sf))


@query("queue_join", with_ctes("""SELECT store_id, visitor_id, ts, event_id, 'BILLING_QUEUE_JOIN' AS event_type,
  depth AS queue_depth FROM qd WHERE delta = 1 AND depth - 1 >= 1""", EV, GAPS, QUEUE))
def _(spark, sf):
    return queueing.queue_joins(queueing.queue_depth(intervals(spark, sf)), QueueConfig(density_threshold=1))


@query("queue_abandon", with_ctes("""SELECT store_id, visitor_id, event_id, 'BILLING_QUEUE_ABANDON' AS event_type,
  leave_time AS ts, CAST(120 AS DOUBLE) AS dwell_seconds FROM qi WHERE abandoned""", EV, GAPS, QUEUE))
def _(spark, sf):
    return queueing.queue_abandons(intervals(spark, sf))


@query("queue_snapshot", with_ctes("""SELECT store_id, count(*) OVER (PARTITION BY store_id) AS queue_depth,
  count(*) OVER (PARTITION BY store_id) >= 1 AS is_active, visitor_id, zone_id,
  (epoch_us(t) - epoch_us(join_time)) / CAST(1e6 AS DOUBLE) AS wait_seconds
  FROM qi, (SELECT max(join_time) AS t FROM qi) WHERE join_time <= t AND (leave_time IS NULL OR t < leave_time)""", EV, GAPS, QUEUE))
def _(spark, sf):
    q = intervals(spark, sf)
    at = b.events(spark, sf).where(F.col("event_type") == "BILLING_QUEUE_JOIN").agg(F.max("ts")).scalar()
    return queueing.queue_snapshot(q, at, QueueConfig(density_threshold=1))


PROFILE = f"""vp AS (SELECT store_id, visitor_id, min(ts) AS first_seen, max(ts) AS last_seen,
  coalesce({xsum('dwell_seconds')}, 0) AS total_dwell_seconds, CAST(count(DISTINCT zone_id) AS INTEGER) AS zones,
  CAST(count(DISTINCT event_date) AS INTEGER) AS days, bool_or(abs(hour(ts) - 9) <= 1) AS seen_at_open,
  bool_or(abs(hour(ts) - 21) <= 1) AS seen_at_close FROM ev GROUP BY 1, 2),
ss AS (SELECT *, {rnd('''CAST(0.35 AS DOUBLE) * least(1, total_dwell_seconds / 3600 / 3)
  + CAST(0.25 AS DOUBLE) * least(1, zones / CAST(6 AS DOUBLE)) + CAST(0.25 AS DOUBLE) * least(1, (days - 1) / CAST(5 AS DOUBLE))
  + CAST(0.15 AS DOUBLE) * (CASE WHEN seen_at_open THEN CAST(0.5 AS DOUBLE) ELSE 0 END + CASE WHEN seen_at_close THEN CAST(0.5 AS DOUBLE) ELSE 0 END)''', 4)} AS staff_score FROM vp)"""


def scores(spark, sf):
    ev = b.events(spark, sf)
    profile = staff.visitor_profile(ev, rollups.event_dwell(ev))
    return staff.staff_scores(profile)


@query("visitor_profile", with_ctes("SELECT * FROM vp", EV, PROFILE))
def _(spark, sf):
    return scores(spark, sf).drop("staff_score")


@query("staff_score", with_ctes("SELECT store_id, visitor_id, staff_score FROM ss", EV, PROFILE))
def _(spark, sf):
    return scores(spark, sf).select("store_id", "visitor_id", "staff_score")


@query("staff_classify", with_ctes("""SELECT event_id, store_id, visitor_id, coalesce(staff_score >= 0.75, false) AS is_staff
  FROM ev JOIN ss USING (store_id, visitor_id)""", EV, PROFILE))
def _(spark, sf):
    listed = staff.staff_members(scores(spark, sf))
    return staff.mark_staff(b.events(spark, sf), listed).select("event_id", "store_id", "visitor_id", "is_staff")


