"""Tables derived from the binding that several registered queries share, with their oracle CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.operators import rollups, sessions
from dwellgrid.plans import binding
from dwellgrid.plans.binding import rnd, xsum
from dwellgrid.session import cut_lineage


def latest(spark: SparkSession, sf_dir: str) -> Column:
    """As-of time of a report: the newest event of the data, a subquery of the plan that uses it."""
    return binding.table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp")).scalar()


def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_fold(binding.events(spark, sf_dir))


def hourly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.hourly_metrics(
        binding.events(spark, sf_dir), session_table(spark, sf_dir), binding.transactions(spark, sf_dir),
        latest(spark, sf_dir),
    )


def stored_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup as a written table, for reports that read it several times."""
    return cut_lineage(hourly_table(spark, sf_dir))


def daily_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.daily_metrics(hourly_table(spark, sf_dir))


SESS = """sess AS (
  SELECT session_name, store_id, visitor_id, event_date, min(ts) AS entry_time,
    max(ts) FILTER (event_type = 'EXIT') AS exit_time,
    (epoch_us(max(ts) FILTER (event_type = 'EXIT')) - epoch_us(min(ts))) / CAST(1e6 AS DOUBLE) AS dwell_seconds,
    bool_or(event_type = 'PURCHASE') AS is_converted, bool_or(is_staff) AS is_staff,
    bool_or(event_type = 'REENTRY') AS is_reentry
  FROM ev GROUP BY session_name, store_id, visitor_id, event_date),
newest AS (SELECT max(ts) AS t FROM ev),
sessd AS (SELECT *, coalesce(dwell_seconds, (epoch_us((SELECT t FROM newest)) - epoch_us(entry_time)) / CAST(1e6 AS DOUBLE))
  AS effective_dwell FROM sess)"""

_avg_eff = f"coalesce({xsum('CASE WHEN NOT is_staff THEN effective_dwell END')} / count(*) FILTER (NOT is_staff), 0)"

HOURLY_PARTS = f"""hs AS (
  SELECT store_id, date_trunc('hour', entry_time) AS hour_bucket,
    count(*) FILTER (NOT is_staff) AS unique_visitors, count(*) FILTER (is_staff) AS staff_count,
    count(*) FILTER (NOT is_staff AND is_converted) AS conversions,
    {_avg_eff} AS avg_dwell_seconds, count(*) FILTER (is_reentry) AS reentry_count
  FROM sessd GROUP BY 1, 2),
hq AS (
  SELECT store_id, date_trunc('hour', ts) AS hour_bucket, coalesce(max(queue_depth), 0) AS max_queue_depth,
    count(*) FILTER (event_type = 'BILLING_QUEUE_ABANDON') AS abandonment_count
  FROM ev WHERE event_type IN ('BILLING_QUEUE_JOIN', 'BILLING_QUEUE_ABANDON') GROUP BY 1, 2),
hr AS (SELECT store_id, date_trunc('hour', ts) AS hour_bucket, {xsum('amount')} AS total_revenue FROM tx GROUP BY 1, 2),
hzd AS (SELECT DISTINCT store_id, date_trunc('hour', ts) AS hour_bucket FROM ev WHERE event_type = 'ZONE_DWELL')"""

HOURLY = HOURLY_PARTS + """,
hkeys AS (SELECT store_id, hour_bucket FROM hs UNION SELECT store_id, hour_bucket FROM hq
  UNION SELECT store_id, hour_bucket FROM hr UNION SELECT store_id, hour_bucket FROM hzd),
hourly AS (
  SELECT k.store_id, k.hour_bucket, strftime(k.hour_bucket, '%Y-%m-%d') AS event_date,
    coalesce(unique_visitors, 0) AS unique_visitors, coalesce(staff_count, 0) AS staff_count,
    coalesce(conversions, 0) AS conversions, coalesce(avg_dwell_seconds, 0) AS avg_dwell_seconds,
    coalesce(reentry_count, 0) AS reentry_count, coalesce(max_queue_depth, 0) AS max_queue_depth,
    coalesce(abandonment_count, 0) AS abandonment_count, coalesce(total_revenue, 0) AS total_revenue
  FROM hkeys k LEFT JOIN hs USING (store_id, hour_bucket) LEFT JOIN hq USING (store_id, hour_bucket)
  LEFT JOIN hr USING (store_id, hour_bucket))"""

DAILY = f"""daily AS (
  SELECT store_id, event_date, CAST(sum(unique_visitors) AS BIGINT) AS unique_visitors,
    CAST(sum(staff_count) AS BIGINT) AS staff_count, CAST(sum(conversions) AS BIGINT) AS conversions,
    {rnd(xsum('avg_dwell_seconds') + ' / count(*)', 4)} AS avg_dwell_seconds, max(max_queue_depth) AS max_queue_depth,
    CAST(sum(abandonment_count) AS BIGINT) AS abandonment_count,
    CAST(sum(reentry_count) AS BIGINT) AS reentry_count, {xsum('total_revenue')} AS total_revenue,
    CAST(arg_max(hour(hour_bucket), unique_visitors * 100 - hour(hour_bucket)) AS INTEGER) AS peak_hour,
    CASE WHEN sum(unique_visitors) > 0 THEN
      {rnd('CAST(sum(conversions) AS DOUBLE) / CAST(sum(unique_visitors) AS DOUBLE)', 4)} ELSE 0 END AS conversion_rate
  FROM hourly GROUP BY store_id, event_date)"""

STAGES = """vs AS (
  SELECT store_id, event_date, visitor_id,
    max(CAST(event_type = 'ENTRY' AS INTEGER)) AS has_entry,
    max(CAST(event_type IN ('ZONE_ENTER', 'ZONE_DWELL') AS INTEGER)) AS has_engagement,
    max(CAST(event_type = 'BILLING_QUEUE_JOIN' AS INTEGER)) AS has_billing,
    max(CAST(event_type = 'PURCHASE' AS INTEGER)) AS has_purchase,
    max(CAST(event_type = 'EXIT' AS INTEGER)) AS has_exit,
    max(CAST(event_type = 'REENTRY' AS INTEGER)) AS has_reentry,
    count(DISTINCT camera_id) AS cam_count
  FROM ev WHERE NOT is_staff GROUP BY 1, 2, 3),
vj AS (SELECT store_id, event_date, visitor_id, has_entry, has_entry * has_engagement AS reached_engagement,
    has_entry * has_engagement * has_billing AS reached_billing,
    has_entry * has_engagement * has_billing * has_purchase AS reached_purchase, has_exit, has_reentry, cam_count FROM vs),
jt AS (SELECT store_id, event_date, count(*) AS unique_visitors,
    CAST(sum(has_entry) AS BIGINT) AS entry_count, CAST(sum(reached_engagement) AS BIGINT) AS zone_engagement_count,
    CAST(sum(reached_billing) AS BIGINT) AS billing_queue_count, CAST(sum(reached_purchase) AS BIGINT) AS purchases_count,
    CAST(sum(has_exit) AS BIGINT) AS exit_count, CAST(sum(has_reentry) AS BIGINT) AS reentry_count,
    count(*) FILTER (cam_count > 1) AS cross_camera_visitors FROM vj GROUP BY 1, 2)"""

FSTAGES = f"""fs AS (
  SELECT store_id, event_date, s.stage_order, s.stage,
    CASE s.stage_order WHEN 0 THEN entry_count WHEN 1 THEN zone_engagement_count WHEN 2 THEN billing_queue_count
      ELSE purchases_count END AS "count",
    CASE s.stage_order WHEN 0 THEN CAST(1 AS DOUBLE)
      WHEN 1 THEN CASE WHEN entry_count > 0 THEN {rnd('CAST(zone_engagement_count AS DOUBLE) / entry_count', 4)} ELSE 0 END
      WHEN 2 THEN CASE WHEN zone_engagement_count > 0 THEN {rnd('CAST(billing_queue_count AS DOUBLE) / zone_engagement_count', 4)} ELSE 0 END
      ELSE CASE WHEN billing_queue_count > 0 THEN {rnd('CAST(purchases_count AS DOUBLE) / billing_queue_count', 4)} ELSE 0 END
      END AS rate
  FROM jt, (VALUES (0, 'ENTRY'), (1, 'ZONE_ENGAGEMENT'), (2, 'BILLING_ZONE_REACHED'), (3, 'CONVERTED')) s(stage_order, stage))"""
