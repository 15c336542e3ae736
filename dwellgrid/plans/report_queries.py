"""Registered queries: event-stream KPIs, heatmap and feed health."""

from pyspark.sql import functions as F

from dwellgrid.functions.labels import lag_label
from dwellgrid.operators import health, heatmap, kpis
from dwellgrid.plans import binding as b
from dwellgrid.plans import derived as d
from dwellgrid.plans.binding import EV, ZN, rnd, with_ctes, xsum
from dwellgrid.plans.registry import query

DAYS = "SELECT store_id, event_date"


def _pct(part, whole):
    return f"CASE WHEN {whole} > 0 THEN {rnd(f'CAST({part} AS DOUBLE) / {whole} * 100', 1)} ELSE 0 END"


KPIS = f"""g1 AS ({DAYS}, *, greatest(0, entry_count + reentry_count - exit_count) AS current_occupancy FROM (
  {DAYS}, count(*) FILTER (event_type = 'ENTRY') AS entry_count, count(*) FILTER (event_type = 'EXIT') AS exit_count,
  count(*) FILTER (event_type = 'REENTRY') AS reentry_count FROM ev GROUP BY 1, 2)),
g2 AS ({DAYS}, count(*) FILTER (event_type = 'ZONE_ENTER') AS zone_enter_count,
  count(*) FILTER (event_type = 'ZONE_EXIT') AS zone_exit_count, count(*) FILTER (event_type = 'ZONE_DWELL') AS zone_dwell_count,
  coalesce({xsum('dwell_seconds')} / nullif(count(dwell_seconds), 0), 0) AS avg_dwell_seconds FROM ev GROUP BY 1, 2),
g3 AS (SELECT *, {_pct('queue_abandon_count', 'queue_join_count')} AS queue_abandon_rate,
  {_pct('purchase_count', 'queue_join_count')} AS billing_conversion_rate FROM ({DAYS},
  count(DISTINCT visitor_id) FILTER (event_type = 'BILLING_QUEUE_JOIN') AS queue_join_count,
  count(DISTINCT visitor_id) FILTER (event_type = 'BILLING_QUEUE_ABANDON') AS queue_abandon_count,
  count(DISTINCT visitor_id) FILTER (event_type = 'PURCHASE') AS purchase_count FROM ev GROUP BY 1, 2)),
g4 AS (SELECT *, {_pct('cross_camera_matches', 'total_visitors')} AS match_rate,
  total_visitors - cross_camera_matches AS fragmented_visitors FROM ({DAYS}, count(*) AS total_visitors,
  count(*) FILTER (cams > 1) AS cross_camera_matches FROM ({DAYS}, visitor_id, count(DISTINCT camera_id) AS cams
  FROM ev GROUP BY 1, 2, 3) GROUP BY 1, 2)),
g5 AS ({DAYS}, {rnd(xsum('confidence') + ' / count(*) * 100', 1)} AS avg_confidence FROM ev GROUP BY 1, 2)"""
KPIS = KPIS.replace("SELECT store_id, event_date, *, greatest", "SELECT *, greatest")


@query("entrance_stats", with_ctes("SELECT * FROM g1", EV, KPIS))
def _(spark, sf):
    return kpis.entrance_stats(b.events(spark, sf))


@query("zone_stats", with_ctes("SELECT * FROM g2", EV, KPIS))
def _(spark, sf):
    return kpis.zone_stats(b.events(spark, sf))


@query("billing_stats", with_ctes("SELECT * FROM g3", EV, KPIS))
def _(spark, sf):
    return kpis.billing_stats(b.events(spark, sf))


@query("reid_stats_day", with_ctes("SELECT * FROM g4", EV, KPIS))
def _(spark, sf):
    return kpis.reid_stats_day(b.events(spark, sf))


@query("avg_confidence", with_ctes("SELECT * FROM g5", EV, KPIS))
def _(spark, sf):
    return kpis.avg_confidence(b.events(spark, sf))


@query("event_stream_report", with_ctes("""SELECT * FROM g1 JOIN g2 USING (store_id, event_date)
  JOIN g3 USING (store_id, event_date) JOIN g4 USING (store_id, event_date) JOIN g5 USING (store_id, event_date)""", EV, KPIS))
def _(spark, sf):
    return kpis.event_stream_report(b.events(spark, sf)).select(
        "store_id", "event_date", "entrance.*", "zone.*", "billing.*", "reid.*")


@query("occupancy_timeline", with_ctes("""SELECT store_id, ts, event_id, CAST(greatest(0, sum(CASE WHEN event_type = 'EXIT'
  THEN -1 ELSE 1 END) OVER (PARTITION BY store_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS occupancy
  FROM ev WHERE event_type IN ('ENTRY', 'REENTRY', 'EXIT')""", EV))
def _(spark, sf):
    return kpis.occupancy_timeline(b.events(spark, sf))


ZD = "SELECT store_id, event_date, zone_id"
HEAT = f"""h1 AS ({ZD}, count(DISTINCT session_name) AS visitor_count FROM ev WHERE NOT is_staff AND zone_id IS NOT NULL GROUP BY 1, 2, 3),
h2 AS ({ZD}, {xsum('dwell_seconds')} / count(*) AS avg_dwell FROM ev WHERE NOT is_staff AND event_type = 'ZONE_DWELL' GROUP BY 1, 2, 3),
h3 AS ({ZD}, {xsum('(epoch_us(leave_ts) - epoch_us(enter_ts)) / CAST(1e6 AS DOUBLE)')} / count(*) AS fallback_dwell FROM
  (SELECT store_id, event_date, zone_id, session_name, min(ts) AS enter_ts FROM ev WHERE event_type = 'ZONE_ENTER' GROUP BY 1, 2, 3, 4)
  JOIN (SELECT session_name, max(ts) AS leave_ts FROM ev WHERE event_type IN ('ZONE_EXIT', 'EXIT', 'PURCHASE') GROUP BY 1)
  USING (session_name) WHERE leave_ts > enter_ts GROUP BY 1, 2, 3),
h4 AS ({ZD}, count(*) FILTER (event_type = 'ZONE_ENTER') AS zone_enter_count,
  count(*) FILTER (event_type = 'ZONE_EXIT') AS zone_exit_count FROM ev WHERE NOT is_staff AND zone_id IS NOT NULL GROUP BY 1, 2, 3),
hx AS (SELECT zn.store_id, zn.zone_id, zone_name, zone_type, event_date, visitor_count, avg_dwell, fallback_dwell,
  zone_enter_count, zone_exit_count, coalesce(nullif(avg_dwell, 0), fallback_dwell, 0) AS dwell,
  CASE WHEN nullif(avg_dwell, 0) IS NOT NULL THEN 'live_dwell' WHEN fallback_dwell IS NOT NULL THEN 'fallback' ELSE 'none' END AS data_source
  FROM zn JOIN (SELECT DISTINCT store_id, event_date FROM ev) USING (store_id)
  LEFT JOIN h1 USING (store_id, event_date, zone_id) LEFT JOIN h2 USING (store_id, event_date, zone_id)
  LEFT JOIN h3 USING (store_id, event_date, zone_id) LEFT JOIN h4 USING (store_id, event_date, zone_id)),
hm AS (SELECT store_id, event_date, zone_id, zone_name, zone_type, {rnd('dwell', 1)} AS avg_dwell_seconds,
  coalesce(visitor_count, 0) AS visitor_count, coalesce(zone_enter_count, 0) AS zone_enter_count,
  coalesce(zone_exit_count, 0) AS zone_exit_count, {rnd('dwell / top', 4)} AS intensity, data_source
  FROM (SELECT *, coalesce(nullif(greatest(max(avg_dwell) OVER w, max(fallback_dwell) OVER w), 0), 1) AS top
    FROM hx WINDOW w AS (PARTITION BY store_id, event_date))),
hsc AS (SELECT *, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' WHEN score = 0 THEN 'idle' ELSE 'low' END AS tier
  FROM (SELECT *, CASE WHEN sc = 0 THEN 50 ELSE sc END AS score FROM (SELECT *,
  least(100, CAST({rnd('avg_dwell_seconds / 500 * 50 + visitor_count / CAST(1000 AS DOUBLE) * 50', 0)} AS INTEGER)) AS sc FROM hm)))"""


@query("zone_visitors", with_ctes("SELECT * FROM h1", EV, ZN, HEAT))
def _(spark, sf):
    return heatmap.zone_visitors(b.events(spark, sf))


@query("zone_avg_dwell", with_ctes("SELECT * FROM h2", EV, ZN, HEAT))
def _(spark, sf):
    return heatmap.zone_avg_dwell(b.events(spark, sf))


@query("zone_dwell_fallback", with_ctes("SELECT * FROM h3", EV, ZN, HEAT))
def _(spark, sf):
    return heatmap.zone_dwell_fallback(b.events(spark, sf))


@query("zone_enter_exit", with_ctes("SELECT * FROM h4", EV, ZN, HEAT))
def _(spark, sf):
    return heatmap.zone_enter_exit(b.events(spark, sf))


@query("data_confidence", with_ctes("""SELECT store_id, event_date, count(DISTINCT session_name) AS sessions,
  count(DISTINCT session_name) >= 20 AS data_confidence FROM ev WHERE NOT is_staff GROUP BY 1, 2""", EV))
def _(spark, sf):
    return heatmap.data_confidence(b.events(spark, sf))


def heat(spark, sf):
    return heatmap.zone_heatmap(b.zones(spark, sf), b.events(spark, sf))


@query("zone_heatmap", with_ctes("SELECT * FROM hm", EV, ZN, HEAT))
def _(spark, sf):
    return heat(spark, sf)


@query("zone_score", with_ctes("SELECT store_id, event_date, zone_id, score FROM hsc", EV, ZN, HEAT))
def _(spark, sf):
    return heatmap.with_scores(heat(spark, sf)).select("store_id", "event_date", "zone_id", "score")


@query("zone_rank", with_ctes("""SELECT store_id, event_date, zone_id, score, tier, CAST(row_number() OVER (
  PARTITION BY store_id, event_date ORDER BY score DESC, zone_id) AS INTEGER) AS rank FROM hsc""", EV, ZN, HEAT))
def _(spark, sf):
    out = heatmap.zone_rank(heatmap.with_scores(heat(spark, sf)))
    return out.select("store_id", "event_date", "zone_id", "score", "tier", "rank")


@query("zone_top_bottom3", with_ctes("""SELECT * FROM (SELECT store_id, event_date, zone_id, score,
  CAST(row_number() OVER (PARTITION BY store_id, event_date ORDER BY score DESC, zone_id) AS INTEGER) AS from_top,
  CAST(row_number() OVER (PARTITION BY store_id, event_date ORDER BY score, zone_id DESC) AS INTEGER) AS from_bottom
  FROM hsc) WHERE from_top <= 3 OR from_bottom <= 3""", EV, ZN, HEAT))
def _(spark, sf):
    out = heatmap.top_bottom(heatmap.with_scores(heat(spark, sf)))
    return out.select("store_id", "event_date", "zone_id", "score", "from_top", "from_bottom")


@query("zone_filter", with_ctes("SELECT store_id, event_date, zone_id, score, tier FROM hsc WHERE tier = 'high'", EV, ZN, HEAT))
def _(spark, sf):
    out = heatmap.filter_zones(heatmap.with_scores(heat(spark, sf)), tier="high")
    return out.select("store_id", "event_date", "zone_id", "score", "tier")


@query("zone_panel", with_ctes(f"""SELECT store_id, event_date,
  {rnd('sum(conversion_rate * visitors) / greatest(1, CAST(sum(visitors) AS DOUBLE))', 4)} AS weighted_conversion,
  {rnd('avg(trend)', 4)} AS avg_trend, arg_min(zone_id, (-trend, zone_id)) AS biggest_gain_zone,
  arg_min(zone_id, (trend, zone_id)) AS biggest_drop_zone,
  count(*) FILTER (conversion_rate < 15 AND visitors > 3) AS low_converters
  FROM (SELECT *, coalesce((visitors - prev) / greatest(CAST(1 AS DOUBLE), prev) * 100, 0) AS trend FROM (
    SELECT *, lag(visitors) OVER (PARTITION BY store_id, zone_id ORDER BY event_date) AS prev FROM (
      SELECT store_id, event_date, zone_id, count(*) AS visitors, CAST(count(sold) AS DOUBLE) / count(*) * 100 AS conversion_rate
      FROM (SELECT DISTINCT store_id, event_date, zone_id, session_name FROM ev WHERE NOT is_staff AND zone_id IS NOT NULL)
      LEFT JOIN (SELECT DISTINCT session_name, 1 AS sold FROM ev WHERE NOT is_staff AND event_type = 'PURCHASE')
      USING (session_name) GROUP BY 1, 2, 3))) GROUP BY 1, 2""", EV))
def _(spark, sf):
    return heatmap.zone_panel(heatmap.zone_performance(b.events(spark, sf)), low_min_visitors=3)


@query("zone_minmax_scale", with_ctes(f"""SELECT store_id, event_date, zone_id, {rnd('''(avg_dwell_seconds - least(min(avg_dwell_seconds) OVER w, 0)) /
  greatest(1, greatest(max(avg_dwell_seconds) OVER w, 1) - least(min(avg_dwell_seconds) OVER w, 0))''', 6)} AS scaled
  FROM hm WINDOW w AS (PARTITION BY store_id, event_date)""", EV, ZN, HEAT))
def _(spark, sf):
    out = heatmap.minmax_scale(heat(spark, sf))
    return out.select("store_id", "event_date", "zone_id", F.round("scaled", 6).alias("scaled"))


BESTWORST = """bw AS (SELECT store_id, event_date, arg_min(zone_id, (-n, zone_id)) AS top_zone,
  arg_min(zone_id, (n, zone_id)) AS worst_zone FROM (SELECT store_id, event_date, zone_id, count(DISTINCT session_name) AS n
  FROM ev WHERE NOT is_staff AND event_type = 'ZONE_DWELL' GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("best_worst_zone", with_ctes("SELECT * FROM bw", EV, BESTWORST))
def _(spark, sf):
    return heatmap.best_worst_zone(b.events(spark, sf))


FRESH = f"""fr AS (SELECT store_id, max(ts) AS last_event_at, lag, {rnd('lag', 1)} AS lag_seconds, lag > 600 AS stale_feed FROM (
  SELECT store_id, max(ts) AS ts, (epoch_us((SELECT max(ts) FROM ev)) - epoch_us(max(ts))) / CAST(1e6 AS DOUBLE) AS lag
  FROM ev GROUP BY 1) GROUP BY store_id, lag)"""


def fresh(spark, sf):
    return health.feed_freshness(b.stores(spark, sf), b.events(spark, sf), d.latest(spark, sf))


@query("feed_freshness", with_ctes("SELECT store_id, last_event_at, lag_seconds, stale_feed FROM fr", EV, FRESH))
def _(spark, sf):
    return fresh(spark, sf)


@query("feed_status", with_ctes("""SELECT CASE WHEN bool_or(stale_feed) THEN 'degraded' ELSE 'healthy' END AS status,
  count(*) FILTER (stale_feed) AS stale_stores, count(*) AS stores FROM fr""", EV, FRESH))
def _(spark, sf):
    return health.feed_status(fresh(spark, sf))


@query("lag_label", with_ctes(f"""SELECT store_id, CASE WHEN lag_seconds < 60 THEN CAST(CAST({rnd('lag_seconds', 0)} AS BIGINT) AS VARCHAR) || 's ago'
  WHEN lag_seconds < 3600 THEN CAST(CAST({rnd('lag_seconds / 60', 0)} AS BIGINT) AS VARCHAR) || 'm ago'
  ELSE CAST(CAST({rnd('lag_seconds / 3600', 0)} AS BIGINT) AS VARCHAR) || 'h ago' END AS lag_label FROM fr""", EV, FRESH))
def _(spark, sf):
    return fresh(spark, sf).select("store_id", lag_label(F.col("lag_seconds")).alias("lag_label"))


@query("lag_progress", with_ctes(
    f"SELECT store_id, {rnd('least(100, lag_seconds / 600 * 100)', 6)} AS progress FROM fr", EV, FRESH))
def _(spark, sf):
    return fresh(spark, sf).select("store_id", F.round(health.lag_progress(F.col("lag_seconds")), 6).alias("progress"))
