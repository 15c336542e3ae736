"""Registered queries: anomalies."""

from pyspark.sql import functions as F

from dwellgrid.fixed_values import RECOMMENDED_ACTIONS
from dwellgrid.functions.labels import lookup
from dwellgrid.functions.scoring import anomaly_confidence, severity
from dwellgrid.operators import anomaly
from dwellgrid.plans import binding as b
from dwellgrid.plans import derived as d
from dwellgrid.plans.binding import EV, TX, ZN, rnd, uuid5_sql, with_ctes
from dwellgrid.plans.derived import HOURLY, SESS
from dwellgrid.plans.registry import query

BASE = (EV, TX, SESS, HOURLY)
SIG = """sig AS (SELECT store_id, hour_bucket, 'QUEUE_SPIKE' AS anomaly_type, 1 AS direction, CAST(max_queue_depth AS DOUBLE) AS metric_value FROM hourly
  UNION ALL SELECT store_id, hour_bucket, 'CONVERSION_DROP', -1, CAST(conversions AS DOUBLE) / greatest(1, unique_visitors) FROM hourly
  UNION ALL SELECT store_id, hour_bucket, 'TRAFFIC_DROP', -1, CAST(unique_visitors AS DOUBLE) FROM hourly),
bl AS (SELECT *, count(metric_value) OVER w AS n, avg(metric_value) OVER w AS baseline_value, stddev_pop(metric_value) OVER w AS deviation
  FROM sig WINDOW w AS (PARTITION BY store_id, anomaly_type, hour(hour_bucket) ORDER BY hour_bucket
    RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 SECOND PRECEDING)),
zs AS (SELECT *, CASE WHEN n >= 3 AND deviation >= 1e-6 THEN (metric_value - baseline_value) / deviation END AS z FROM bl)"""
SEV = "CASE WHEN abs(z) >= 3.0 THEN 'CRITICAL' WHEN abs(z) >= 2.8 THEN 'HIGH' ELSE 'MEDIUM' END"
CONF = rnd("least(1, least(1, n / CAST(14 AS DOUBLE)) * ((least(abs(z), 5) - 2.5) / 2.5))", 3)
_actions = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RECOMMENDED_ACTIONS.items())
ALERTS = f"""alerts AS (SELECT {uuid5_sql("store_id || '|' || anomaly_type || '|' || strftime(hour_bucket, '%Y-%m-%d %H:%M:%S')")} AS anomaly_id,
  store_id, hour_bucket AS detected_at, anomaly_type, {SEV} AS severity, {CONF} AS confidence, metric_value, baseline_value,
  {rnd('z', 4)} AS z_score, CAST(NULL AS VARCHAR) AS affected_zone_id, CASE anomaly_type {_actions} END AS recommended_action
  FROM zs WHERE z * direction > 2.5)"""
KEPT = """kept AS (SELECT store_id, anomaly_type, min(detected_at) AS detected_at FROM alerts GROUP BY 1, 2
  UNION ALL SELECT k.store_id, k.anomaly_type, min(a.detected_at) FROM kept k JOIN alerts a ON a.store_id = k.store_id
    AND a.anomaly_type = k.anomaly_type AND a.detected_at > k.detected_at + INTERVAL 2 HOUR GROUP BY k.store_id, k.anomaly_type),
ka AS (SELECT a.* FROM alerts a JOIN kept k USING (store_id, anomaly_type, detected_at))"""
DEAD = f"""dz AS (SELECT store_id, zone_id, last_event_at, coalesce(lag_m, 999) AS lag_minutes FROM (
  SELECT zn.store_id, zn.zone_id, last_event_at, (epoch_us((SELECT max(ts) FROM ev)) - epoch_us(last_event_at)) / CAST(1e6 AS DOUBLE) / 60 AS lag_m
  FROM zn LEFT JOIN (SELECT store_id, zone_id, max(ts) AS last_event_at FROM ev WHERE NOT is_staff AND event_type IN ('ZONE_ENTER', 'ZONE_DWELL')
    GROUP BY 1, 2) USING (store_id, zone_id) WHERE zone_type NOT IN ('ENTRY', 'BILLING')) WHERE lag_m IS NULL OR lag_m > 30),
da AS (SELECT {uuid5_sql("store_id || '|DEAD_ZONE|' || zone_id || '|' || strftime((SELECT max(ts) FROM ev), '%Y-%m-%d %H:%M:%S')")} AS anomaly_id,
  store_id, (SELECT max(ts) FROM ev) AS detected_at, 'DEAD_ZONE' AS anomaly_type, 'WARN' AS severity, CAST(0.9 AS DOUBLE) AS confidence,
  {rnd('lag_minutes', 1)} AS metric_value, CAST(30 AS DOUBLE) AS baseline_value, CAST(0 AS DOUBLE) AS z_score, zone_id AS affected_zone_id,
  '{RECOMMENDED_ACTIONS["DEAD_ZONE"]}' AS recommended_action FROM dz),
an AS (SELECT *, detected_at < (SELECT max(ts) FROM ev) - INTERVAL 7 DAY AS is_resolved FROM (SELECT * FROM ka UNION ALL BY NAME SELECT * FROM da))"""
ANOM = (*BASE, ZN, SIG, ALERTS, KEPT, DEAD)


def rec(body: str, *ctes: str) -> str:
    return with_ctes(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def scored(spark, sf, hourly=None):
    return anomaly.scored_signals(d.hourly_table(spark, sf) if hourly is None else hourly)


def found(spark, sf, hourly=None):
    return anomaly.alerts(scored(spark, sf, hourly))


def dead(spark, sf, as_of):
    return anomaly.dead_zones(b.zones(spark, sf), b.events(spark, sf), as_of)


def anomaly_table(spark, sf, hourly=None):
    """All alerts of the data; those older than a week count as resolved."""
    as_of = d.latest(spark, sf)
    both = anomaly.suppress_repeats(found(spark, sf, hourly)).unionByName(anomaly.dead_zone_alerts(dead(spark, sf, as_of), as_of))
    return both.withColumn("is_resolved", F.col("detected_at") < as_of - F.expr("interval 7 days"))


@query("current_hour_row", with_ctes("""SELECT * EXCLUDE (event_date) FROM hourly
  WHERE hour_bucket = date_trunc('hour', (SELECT max(ts) FROM ev))""", *BASE))
def _(spark, sf):
    return anomaly.current_hour_rows(d.hourly_table(spark, sf), d.latest(spark, sf)).drop("zone_dwell")


@query("same_hour_baseline", with_ctes(f"""SELECT store_id, hour_bucket, anomaly_type, metric_value, n,
  {rnd('baseline_value', 6)} AS baseline_value, {rnd('deviation', 6)} AS deviation FROM bl""", *BASE, SIG))
def _(spark, sf):
    return scored(spark, sf).select(
        "store_id", "hour_bucket", "anomaly_type", "metric_value", "n",
        F.round("baseline_value", 6).alias("baseline_value"), F.round("deviation", 6).alias("deviation"))


@query("zscore", with_ctes(f"SELECT store_id, hour_bucket, anomaly_type, {rnd('z', 6)} AS z FROM zs", *BASE, SIG))
def _(spark, sf):
    return scored(spark, sf).select("store_id", "hour_bucket", "anomaly_type", F.round("z", 6).alias("z"))


for _key, _kind in (("queue_spike", "QUEUE_SPIKE"), ("conversion_drop", "CONVERSION_DROP"), ("traffic_drop", "TRAFFIC_DROP")):
    @query(_key, with_ctes(f"""SELECT store_id, detected_at, metric_value, {rnd('baseline_value', 6)} AS baseline_value, z_score
      FROM alerts WHERE anomaly_type = '{_kind}'""", *BASE, SIG, ALERTS))
    def _(spark, sf, kind=_kind):
        return found(spark, sf).where(F.col("anomaly_type") == kind).select(
            "store_id", "detected_at", "metric_value", F.round("baseline_value", 6).alias("baseline_value"), "z_score")


@query("severity", with_ctes(f"SELECT store_id, hour_bucket, anomaly_type, {SEV} AS severity FROM zs WHERE z IS NOT NULL", *BASE, SIG))
def _(spark, sf):
    return scored(spark, sf).where(F.col("z").isNotNull()).select(
        "store_id", "hour_bucket", "anomaly_type", severity(F.col("z")).alias("severity"))


@query("confidence", with_ctes(f"SELECT store_id, hour_bucket, anomaly_type, {CONF} AS confidence FROM zs WHERE z IS NOT NULL", *BASE, SIG))
def _(spark, sf):
    return scored(spark, sf).where(F.col("z").isNotNull()).select(
        "store_id", "hour_bucket", "anomaly_type", anomaly_confidence(F.col("z"), F.col("n")).alias("confidence"))


@query("anomaly_suppress", rec("SELECT anomaly_id, store_id, anomaly_type, detected_at, z_score FROM ka", *BASE, SIG, ALERTS, KEPT))
def _(spark, sf):
    return anomaly.suppress_repeats(found(spark, sf)).select("anomaly_id", "store_id", "anomaly_type", "detected_at", "z_score")


@query("dead_zone", with_ctes(
    "SELECT store_id, zone_id, last_event_at FROM dz", *BASE, ZN, DEAD.split(",\nda AS")[0]))
def _(spark, sf):
    return dead(spark, sf, d.latest(spark, sf)).select("store_id", "zone_id", "last_event_at")


@query("dead_zone_lag", rec("SELECT * FROM da", *ANOM))
def _(spark, sf):
    as_of = d.latest(spark, sf)
    return anomaly.dead_zone_alerts(dead(spark, sf, as_of), as_of)


@query("dead_zone_suppress", rec("""SELECT store_id, affected_zone_id, detected_at, metric_value FROM da WHERE NOT EXISTS (
  SELECT 1 FROM dz o WHERE o.store_id = da.store_id AND o.zone_id = da.affected_zone_id AND o.zone_id IN ('Z_MAKEUP', 'Z_GIFTING'))""", *ANOM))
def _(spark, sf):
    as_of = d.latest(spark, sf)
    now = anomaly.dead_zone_alerts(dead(spark, sf, as_of), as_of)
    open_alerts = now.where(F.col("affected_zone_id").isin("Z_MAKEUP", "Z_GIFTING")).withColumn(
        "detected_at", F.col("detected_at") - F.expr("interval 20 minutes"))
    out = anomaly.suppress_open(now, open_alerts, 3600)
    return out.select("store_id", "affected_zone_id", "detected_at", "metric_value")


@query("recommended_action", rec("SELECT anomaly_id, anomaly_type, recommended_action FROM an", *ANOM))
def _(spark, sf):
    return anomaly_table(spark, sf).select(
        "anomaly_id", "anomaly_type", lookup(F.col("anomaly_type"), RECOMMENDED_ACTIONS).alias("recommended_action"))


ACTIVE = "act AS (SELECT *, count(*) OVER (PARTITION BY store_id) AS active_count FROM an WHERE NOT is_resolved)"


@query("active_anomalies", rec("""SELECT anomaly_id, store_id, detected_at, anomaly_type, severity, metric_value, z_score,
  affected_zone_id, active_count FROM act""", *ANOM, ACTIVE))
def _(spark, sf):
    return anomaly.active_anomalies(anomaly_table(spark, sf)).select(
        "anomaly_id", "store_id", "detected_at", "anomaly_type", "severity", "metric_value", "z_score",
        "affected_zone_id", "active_count").orderBy(F.desc("detected_at"))


CTX = """hl1 AS (SELECT store_id, arg_max(conversions, hour_bucket) AS c, arg_max(unique_visitors, hour_bucket) AS v FROM hourly GROUP BY 1)"""


@query("anomaly_context", rec("""SELECT anomaly_id, store_id, anomaly_type, CASE WHEN v > 0 THEN CAST(c AS DOUBLE) / v END AS conversion_rate
  FROM an LEFT JOIN hl1 USING (store_id)""", *ANOM, CTX))
def _(spark, sf):
    hourly = d.stored_hourly(spark, sf)
    return anomaly.with_store_context(anomaly_table(spark, sf, hourly), hourly).select(
        "anomaly_id", "store_id", "anomaly_type", "conversion_rate")


DELTA = "((metric_value - baseline_value) / greatest(abs(baseline_value), 1e-6) * 100)"


@query("trend_delta", rec(f"""SELECT anomaly_id, {rnd(DELTA, 4)} AS delta_pct, CASE WHEN {DELTA} > 0 THEN 'above' ELSE 'below' END AS direction,
  'Current value is ' || printf('%.0f', {rnd(f'abs({DELTA})', 0)}) || '% ' || CASE WHEN {DELTA} > 0 THEN 'above' ELSE 'below' END ||
  ' the 7-day same-hour average (z-score ' || printf('%.2f', {rnd('z_score', 2)}) || ').' AS trend_summary FROM an""", *ANOM))
def _(spark, sf):
    return anomaly.trend_summary(anomaly_table(spark, sf)).select("anomaly_id", "delta_pct", "direction", "trend_summary")


@query("anomaly_counts", rec("""SELECT store_id, CASE WHEN severity = 'CRITICAL' THEN 'CRITICAL' WHEN severity IN ('HIGH', 'MEDIUM') THEN 'WARN'
  ELSE 'INFO' END AS severity_class, count(*) AS anomalies FROM an GROUP BY 1, 2""", *ANOM))
def _(spark, sf):
    return anomaly.counts_by_severity(anomaly_table(spark, sf)).orderBy(F.desc("anomalies"))


@query("anomaly_zone_counts", rec(
    "SELECT store_id, coalesce(affected_zone_id, 'Other') AS zone, count(*) AS anomalies FROM an GROUP BY 1, 2", *ANOM))
def _(spark, sf):
    return anomaly.counts_by_zone(anomaly_table(spark, sf)).orderBy(F.desc("anomalies"))


@query("anomaly_title", rec(f"""SELECT anomaly_id, CASE WHEN anomaly_type = 'DEAD_ZONE' THEN 'Zone inactive for ' ||
  printf('%.0f', {rnd('metric_value', 0)}) || ' min · ' || affected_zone_id ELSE replace(anomaly_type, '_', ' ') || ' detected (z = ' ||
  printf('%.1f', {rnd('z_score', 1)}) || ', ' || printf('%.0f', {rnd('confidence * 100', 0)}) || '% confidence)' END AS title FROM an""", *ANOM))
def _(spark, sf):
    return anomaly_table(spark, sf).select("anomaly_id", anomaly.anomaly_title().alias("title"))
