"""Registered queries: sessions, funnel and rollups."""

from pyspark.sql import functions as F

from dwellgrid.operators import funnel, rollups, sessions
from dwellgrid.plans import binding as b
from dwellgrid.plans import derived as d
from dwellgrid.plans.binding import EV, TX, rnd, uuid5_sql, with_ctes
from dwellgrid.plans.derived import DAILY, FSTAGES, HOURLY, HOURLY_PARTS, SESS, STAGES
from dwellgrid.plans.registry import query
from dwellgrid.session import cut_lineage


@query("session_uuid5", with_ctes(f"SELECT event_id, {uuid5_sql('session_name')} AS session_id FROM ev", EV))
def _(spark, sf):
    return b.events(spark, sf).select("event_id", "session_id")


ZLIST = """zl AS (SELECT session_name, string_agg(zone_id, ',' ORDER BY f, zone_id) AS zones FROM
  (SELECT session_name, zone_id, min(ts) AS f FROM ev WHERE zone_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


@query("session_fold", with_ctes(f"""SELECT {uuid5_sql('s.session_name')} AS session_id, store_id, visitor_id, entry_time,
  exit_time, dwell_seconds, is_converted, is_staff, is_reentry, coalesce(zl.zones, '') AS zones_visited
  FROM sess s LEFT JOIN zl ON zl.session_name = s.session_name""", EV, SESS, ZLIST))
def _(spark, sf):
    s = d.session_table(spark, sf)
    return s.withColumn("zones_visited", F.array_join("zones_visited", ","))


VISITS = f"""vz AS (SELECT *, visitor_id || ':' || store_id || ':' || event_date || ':' || visit_no AS visit_name FROM (
  SELECT *, CAST(sum(CASE WHEN gap BETWEEN 300000000 AND 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY store_id, visitor_id
    ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit_no FROM (
    SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY store_id, visitor_id ORDER BY ts, event_id)) AS gap FROM ev)))"""


@query("visit_sessions", with_ctes(f"""SELECT {uuid5_sql('visit_name')} AS session_id, store_id, visitor_id, visit_no, min(ts) AS entry_time,
  max(ts) FILTER (event_type = 'EXIT') AS exit_time, bool_or(event_type = 'PURCHASE') AS is_converted, count(*) AS events
  FROM vz GROUP BY visit_name, store_id, visitor_id, event_date, visit_no""", EV, VISITS))
def _(spark, sf):
    ev = sessions.with_visit_sessions(b.events(spark, sf))
    visits = ev.groupBy("session_id").agg(F.min("visit_no").alias("visit_no"), F.count("*").alias("events"))
    return sessions.session_fold(ev).join(visits, "session_id").select(
        "session_id", "store_id", "visitor_id", "visit_no", "entry_time", "exit_time", "is_converted", "events")


@query("session_dwell", with_ctes(
    f"SELECT {uuid5_sql('session_name')} AS session_id, store_id, effective_dwell FROM sessd", EV, SESS))
def _(spark, sf):
    out = sessions.session_dwell(d.session_table(spark, sf), d.latest(spark, sf))
    return out.select("session_id", "store_id", "effective_dwell")


@query("sessions_by_gap", with_ctes("""SELECT store_id, visitor_id, visit_no, min(ts) AS start_ts, max(ts) AS end_ts,
  count(*) AS events FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY store_id, visitor_id ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit_no FROM (
    SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS new
    FROM ev WINDOW w AS (PARTITION BY store_id, visitor_id ORDER BY ts, event_id)))
  GROUP BY 1, 2, 3""", EV))
def _(spark, sf):
    return sessions.sessions_by_gap(b.events(spark, sf))


@query("visitor_stages", with_ctes("SELECT * FROM vs", EV, STAGES))
def _(spark, sf):
    return funnel.visitor_stages(b.events(spark, sf))


@query("visitor_journeys", with_ctes("SELECT * FROM vj", EV, STAGES))
def _(spark, sf):
    return funnel.visitor_journeys(funnel.visitor_stages(b.events(spark, sf)))


def totals(spark, sf):
    return funnel.store_day_funnel(b.events(spark, sf))


@query("journey_totals", with_ctes("SELECT * FROM jt", EV, STAGES))
def _(spark, sf):
    return totals(spark, sf)


@query("cross_camera_rate", with_ctes("""SELECT store_id, event_date,
  coalesce(CAST(cross_camera_visitors AS DOUBLE) / nullif(unique_visitors, 0), 0) AS cross_camera_match_rate FROM jt""", EV, STAGES))
def _(spark, sf):
    return funnel.cross_camera_rate(totals(spark, sf))


@query("funnel_hierarchy_check", with_ctes("""SELECT *, purchases_count <= billing_queue_count
  AND billing_queue_count <= zone_engagement_count AND zone_engagement_count <= entry_count AS hierarchy_ok FROM jt""", EV, STAGES))
def _(spark, sf):
    return funnel.hierarchy_check(totals(spark, sf))


@query("funnel_stages", with_ctes("SELECT * FROM fs", EV, STAGES, FSTAGES))
def _(spark, sf):
    return funnel.funnel_stages(totals(spark, sf))


@query("conversion_rate", with_ctes(f"""SELECT store_id, event_date, CASE WHEN entry_count > 0 THEN
  least(1, {rnd('CAST(purchases_count AS DOUBLE) / greatest(1, entry_count)', 4)}) ELSE 0 END AS conversion_rate FROM jt""", EV, STAGES))
def _(spark, sf):
    rate = funnel.conversion_rate(F.col("purchases_count"), F.col("entry_count"))
    return totals(spark, sf).select("store_id", "event_date", rate.alias("conversion_rate"))


@query("abandonment_visitors", with_ctes("""SELECT store_id, event_date,
  count(DISTINCT visitor_id) FILTER (event_type = 'BILLING_QUEUE_ABANDON') AS abandonment_visitors
  FROM ev WHERE NOT is_staff GROUP BY 1, 2""", EV))
def _(spark, sf):
    return funnel.abandonment_visitors(b.events(spark, sf))


@query("hourly_breakdown", with_ctes(f"""SELECT store_id, event_date, hour_bucket, unique_visitors, conversions,
  {rnd('CAST(conversions AS DOUBLE) / greatest(1, unique_visitors)', 4)} AS conversion_rate FROM hourly""", EV, TX, SESS, HOURLY))
def _(spark, sf):
    return rollups.hourly_breakdown(d.hourly_table(spark, sf))


HLIST = f"""hl AS (SELECT store_id, event_date, string_agg(CAST(hour(hour_bucket) AS VARCHAR) || '=' ||
  CAST(unique_visitors AS VARCHAR) || '/' || CAST(conversions AS VARCHAR), ',' ORDER BY hour_bucket) AS hourly_breakdown
  FROM hourly GROUP BY 1, 2),
ab AS (SELECT store_id, event_date, count(DISTINCT visitor_id) AS abandonment_count FROM ev
  WHERE NOT is_staff AND event_type = 'BILLING_QUEUE_ABANDON' GROUP BY 1, 2)"""


@query("store_metrics", with_ctes(f"""SELECT j.store_id, j.event_date, j.unique_visitors, entry_count, exit_count,
  j.reentry_count, zone_engagement_count, billing_queue_count, purchases_count,
  CASE WHEN entry_count > 0 THEN least(1, {rnd('CAST(purchases_count AS DOUBLE) / greatest(1, entry_count)', 4)}) ELSE 0 END AS conversion_rate,
  CAST(cross_camera_visitors AS DOUBLE) / j.unique_visitors AS cross_camera_match_rate,
  dl.staff_count, dl.avg_dwell_seconds, dl.total_revenue, dl.peak_hour, dl.max_queue_depth,
  coalesce(ab.abandonment_count, 0) AS abandonment_count, hl.hourly_breakdown
  FROM jt j LEFT JOIN daily dl USING (store_id, event_date) LEFT JOIN ab USING (store_id, event_date)
  LEFT JOIN hl USING (store_id, event_date)""", EV, TX, SESS, HOURLY, DAILY, STAGES, HLIST))
def _(spark, sf):
    ev, hourly, as_of = b.events(spark, sf), d.stored_hourly(spark, sf), d.latest(spark, sf)
    live = rollups.live_supplementary(d.session_table(spark, sf), b.transactions(spark, sf), as_of)
    out = rollups.store_metrics(ev, rollups.daily_metrics(hourly), live, hourly)
    text = F.transform("hourly_breakdown", lambda h: F.concat_ws(
        "", F.hour(h["hour_bucket"]).cast("string"), F.lit("="), h["unique_visitors"].cast("string"),
        F.lit("/"), h["conversions"].cast("string")))
    return out.withColumn("hourly_breakdown", F.array_join(text, ","))


@query("live_supplementary", with_ctes(f"""SELECT store_id, event_date, staff_count, avg_dwell_seconds,
  coalesce(total_revenue, 0) AS total_revenue FROM (SELECT store_id, event_date, count(*) FILTER (is_staff) AS staff_count,
    {d._avg_eff} AS avg_dwell_seconds FROM sessd GROUP BY 1, 2) LEFT JOIN (SELECT store_id,
    strftime(ts, '%Y-%m-%d') AS event_date, {b.xsum('amount')} AS total_revenue FROM tx GROUP BY 1, 2) USING (store_id, event_date)""",
    EV, TX, SESS))
def _(spark, sf):
    return rollups.live_supplementary(d.session_table(spark, sf), b.transactions(spark, sf), d.latest(spark, sf))


@query("hourly_sessions", with_ctes("SELECT * FROM hs", EV, TX, SESS, HOURLY_PARTS))
def _(spark, sf):
    return rollups.hourly_sessions(d.session_table(spark, sf), d.latest(spark, sf))


@query("hourly_queue", with_ctes("SELECT * FROM hq", EV, TX, SESS, HOURLY_PARTS))
def _(spark, sf):
    return rollups.hourly_queue(b.events(spark, sf))


@query("hourly_revenue", with_ctes("SELECT * FROM hr", EV, TX, SESS, HOURLY_PARTS))
def _(spark, sf):
    return rollups.hourly_revenue(b.transactions(spark, sf))


HZMAP = f"""hzm AS (SELECT store_id, hour_bucket, string_agg(zone_id || '=' || printf('%.2f', a), ',' ORDER BY zone_id) AS zone_dwell
  FROM (SELECT store_id, date_trunc('hour', ts) AS hour_bucket, zone_id,
    {rnd(b.xsum('dwell_seconds') + ' / count(*)', 2)} AS a FROM ev WHERE event_type = 'ZONE_DWELL' GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("hourly_metrics", with_ctes("""SELECT h.* EXCLUDE (event_date), coalesce(zone_dwell, '') AS zone_dwell
  FROM hourly h LEFT JOIN hzm USING (store_id, hour_bucket)""", EV, TX, SESS, HOURLY, HZMAP))
def _(spark, sf):
    text = F.transform(F.map_entries("zone_dwell"), lambda e: F.concat(
        e["key"], F.lit("="), F.format_string("%.2f", F.round(e["value"], 2))))
    return d.hourly_table(spark, sf).withColumn("zone_dwell", F.array_join(F.sort_array(text), ","))


@query("distinct_visitors", with_ctes("""SELECT store_id, 'day' AS level, event_date AS period, count(DISTINCT visitor_id) AS visitors, count(*) AS events
  FROM ev WHERE NOT is_staff GROUP BY 1, 3
  UNION ALL SELECT store_id, 'week', strftime(date_trunc('week', ts), '%Y-%m-%d'), count(DISTINCT visitor_id), count(*) FROM ev WHERE NOT is_staff GROUP BY 1, 3
  UNION ALL SELECT store_id, 'all', '', count(DISTINCT visitor_id), count(*) FROM ev WHERE NOT is_staff GROUP BY 1""", EV))
def _(spark, sf):
    hours = cut_lineage(rollups.visitor_sketches(b.events(spark, sf)))
    out = None
    for level, start in (("day", F.to_date("hour_bucket")), ("week", F.to_date(F.date_trunc("week", "hour_bucket"))), ("all", None)):
        found = rollups.distinct_visitors(hours, *([] if start is None else [start.cast("string").alias("period")]))
        if start is None:
            found = found.withColumn("period", F.lit(""))
        part = found.select("store_id", F.lit(level).alias("level"), "period", "visitors", "events")
        out = part if out is None else out.unionByName(part)
    return out


@query("total_levels", with_ctes(f"""SELECT store_id, event_date, hour, count(*) AS events, count(DISTINCT visitor_id) AS visitors,
  coalesce({b.xsum("CASE WHEN event_type = 'PURCHASE' THEN value END")}, 0) AS revenue,
  CASE grouping(store_id, event_date, hour) WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 3 THEN 'store' ELSE 'chain' END AS level
  FROM (SELECT *, extract(hour FROM ts) AS hour FROM ev WHERE NOT is_staff) GROUP BY ROLLUP (store_id, event_date, hour)""", EV))
def _(spark, sf):
    out = rollups.total_levels(b.events(spark, sf))
    return out.withColumn("event_date", F.col("event_date").cast("string")).withColumn("hour", F.col("hour").cast("long"))


@query("daily_metrics", with_ctes("SELECT * FROM daily", EV, TX, SESS, HOURLY, DAILY))
def _(spark, sf):
    return d.daily_table(spark, sf)


@query("peak_hour", with_ctes("SELECT store_id, event_date, peak_hour FROM daily", EV, TX, SESS, HOURLY, DAILY))
def _(spark, sf):
    return rollups.peak_hour(d.hourly_table(spark, sf))


@query("daily_conversion_rate", with_ctes(
    "SELECT store_id, event_date, conversion_rate FROM daily", EV, TX, SESS, HOURLY, DAILY))
def _(spark, sf):
    return d.daily_table(spark, sf).select("store_id", "event_date", "conversion_rate")


@query("affected_buckets", with_ctes(
    "SELECT DISTINCT store_id, date_trunc('hour', ts) AS hour_bucket, event_date FROM ev", EV))
def _(spark, sf):
    return rollups.affected_buckets(b.events(spark, sf))


@query("zero_fill", with_ctes("""SELECT p.store_id, p.event_date, coalesce(unique_visitors, 0) AS unique_visitors,
  coalesce(entry_count, 0) AS entry_count, coalesce(zone_engagement_count, 0) AS zone_engagement_count,
  coalesce(billing_queue_count, 0) AS billing_queue_count, coalesce(purchases_count, 0) AS purchases_count,
  coalesce(exit_count, 0) AS exit_count, coalesce(reentry_count, 0) AS reentry_count,
  coalesce(cross_camera_visitors, 0) AS cross_camera_visitors
  FROM (SELECT store_id, strftime(dd, '%Y-%m-%d') AS event_date FROM (SELECT DISTINCT store_id FROM ev),
    (SELECT unnest(generate_series(date_trunc('day', min(ts)) - INTERVAL 1 DAY, date_trunc('day', max(ts)) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS dd FROM ev)) p
  LEFT JOIN jt USING (store_id, event_date)""", EV, STAGES))
def _(spark, sf):
    ev = b.events(spark, sf)
    first, last = ev.agg(F.min("event_date")).scalar(), ev.agg(F.max("event_date")).scalar()
    spine = funnel.store_day_spine(b.stores(spark, sf), F.date_sub(first, 1), F.date_add(last, 1))
    return funnel.zero_fill(totals(spark, sf), spine)


SUMMARY = f"""sm AS (SELECT store_id, event_date,
  count(DISTINCT session_name) FILTER (event_type = 'ENTRY') AS visitors,
  count(DISTINCT session_name) FILTER (event_type = 'ZONE_DWELL') AS engagement,
  count(DISTINCT session_name) FILTER (event_type = 'PURCHASE') AS purchases,
  count(DISTINCT session_name) FILTER (event_type = 'BILLING_QUEUE_JOIN') AS billing_joins,
  coalesce({b.xsum('dwell_seconds')} / nullif(count(dwell_seconds), 0), 0) AS avg_dwell_seconds
  FROM ev WHERE NOT is_staff GROUP BY 1, 2),
smc AS (SELECT *, CASE WHEN billing_joins > 0 THEN printf('%.1f%%', {rnd('CAST(purchases AS DOUBLE) / billing_joins * 100', 1)})
  ELSE '0%' END AS conversion_rate FROM sm)"""


@query("summary_counts", with_ctes("SELECT * FROM smc", EV, SUMMARY))
def _(spark, sf):
    ev = b.events(spark, sf)
    return funnel.summary_counts(ev, rollups.event_dwell(ev))
