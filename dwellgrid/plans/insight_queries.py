"""Registered queries: evidence, rule-based answers and the dashboard funnel."""

from pyspark.sql import functions as F

from dwellgrid.fixed_values import (
    DEFAULT_EXPLANATION, EXPLANATIONS, FUNNEL_STAGES, QUESTION_KEYWORDS, STAGE_BENCHMARKS, STAGE_CAUSES, STAGE_RECOMMENDATIONS,
)
from dwellgrid.functions.labels import hour_label, stage_label
from dwellgrid.operators import evidence, funnel, heatmap, insight, rollups
from dwellgrid.plans import binding as b
from dwellgrid.plans import derived as d
from dwellgrid.plans.anomaly_queries import ANOM, anomaly_table, rec
from dwellgrid.plans.binding import EV, TX, rnd, with_ctes
from dwellgrid.plans.derived import DAILY, FSTAGES, HOURLY, SESS, STAGES
from dwellgrid.plans.funnel_queries import SUMMARY
from dwellgrid.plans.registry import query
from dwellgrid.plans.report_queries import BESTWORST

EVID = f"""l1 AS (SELECT store_id, event_date, unique_visitors, conversions, {rnd('conversion_rate * 100', 1)} AS conversion_rate_pct,
  {rnd('avg_dwell_seconds / 60', 1)} AS avg_dwell_minutes, peak_hour, max_queue_depth, abandonment_count, total_revenue FROM daily),
l2 AS (SELECT store_id, event_date, count(*) AS hours, string_agg(hour(hour_bucket) || ':' || unique_visitors || '/' || conversions || '/' || max_queue_depth,
  ',' ORDER BY hour_bucket) AS hourly FROM hourly GROUP BY 1, 2),
l4 AS (SELECT store_id, event_date, count(DISTINCT session_name) FILTER (event_type = 'ENTRY') AS entries,
  count(DISTINCT session_name) FILTER (event_type = 'ZONE_ENTER') AS zone_engagements,
  count(DISTINCT session_name) FILTER (event_type = 'BILLING_QUEUE_ABANDON') AS queue_abandonments FROM ev WHERE NOT is_staff GROUP BY 1, 2)"""
EVID3 = f"""l3 AS (SELECT store_id, CAST(rank AS INTEGER) AS rank, anomaly_type, severity, metric_value, baseline_value, {rnd('z_score', 2)} AS z_score FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY detected_at DESC, anomaly_type, affected_zone_id) AS rank FROM an WHERE NOT is_resolved)
  WHERE rank <= 5),
cov AS (SELECT store_id, event_date, CAST(l1.store_id IS NOT NULL AS INTEGER) + CAST(l2.store_id IS NOT NULL AS INTEGER)
  + CAST(l4.entries > 0 AS INTEGER) + CAST(store_id IN (SELECT store_id FROM l3) AS INTEGER) AS data_coverage,
  unique_visitors, conversions, conversion_rate_pct, avg_dwell_minutes, peak_hour, max_queue_depth, abandonment_count
  FROM l1 FULL JOIN l2 USING (store_id, event_date) FULL JOIN (SELECT * FROM l4 WHERE entries > 0) l4 USING (store_id, event_date))"""
EVID3 = EVID3.replace("CAST(l4.entries > 0 AS INTEGER)", "CAST(l4.entries IS NOT NULL AS INTEGER)")
FULL = (*ANOM, DAILY, EVID, EVID3)


@query("evidence_daily", with_ctes("SELECT * FROM l1", EV, TX, SESS, HOURLY, DAILY, EVID))
def _(spark, sf):
    return evidence.evidence_daily(d.daily_table(spark, sf))


@query("evidence_hourly", with_ctes("SELECT store_id, event_date, hourly FROM l2", EV, TX, SESS, HOURLY, DAILY, EVID))
def _(spark, sf):
    line = F.transform("hourly_breakdown", lambda h: F.concat(
        h["hour"].cast("string"), F.lit(":"), h["visitors"].cast("string"), F.lit("/"), h["conversions"].cast("string"),
        F.lit("/"), h["queue_depth"].cast("string")))
    return evidence.evidence_hourly(d.hourly_table(spark, sf)).select("store_id", "event_date", F.array_join(line, ",").alias("hourly"))


@query("evidence_anomalies", rec("SELECT store_id, rank, anomaly_type, severity, metric_value, z_score FROM l3", *FULL))
def _(spark, sf):
    return evidence.evidence_anomalies(anomaly_table(spark, sf)).drop("baseline_value")


@query("evidence_funnel", with_ctes("SELECT * FROM l4", EV, TX, SESS, HOURLY, DAILY, EVID))
def _(spark, sf):
    return evidence.evidence_funnel(b.events(spark, sf))


def bundled(spark, sf):
    hourly = d.stored_hourly(spark, sf)
    return evidence.bundle(
        evidence.evidence_daily(rollups.daily_metrics(hourly)), evidence.evidence_hourly(hourly),
        evidence.evidence_anomalies(anomaly_table(spark, sf, hourly)), evidence.evidence_funnel(b.events(spark, sf)))


@query("data_coverage", rec("SELECT store_id, event_date, data_coverage, data_coverage = 0 AS insufficient FROM cov", *FULL))
def _(spark, sf):
    return bundled(spark, sf).select("store_id", "event_date", "data_coverage", (F.col("data_coverage") == 0).alias("insufficient"))


@query("evidence_json", rec("""SELECT store_id, event_date, unique_visitors, conversion_rate_pct, CAST(coalesce(hours, 0) AS BIGINT) AS hours,
  coalesce(entries, 0) AS entries FROM cov LEFT JOIN l2 USING (store_id, event_date)
  LEFT JOIN l4 USING (store_id, event_date)""", *FULL))
def _(spark, sf):
    doc = evidence.evidence_json(bundled(spark, sf))

    def at(path: str, kind: str):
        return F.get_json_object("document", "$.evidence." + path).cast(kind)

    hours = F.json_array_length(F.get_json_object("document", "$.evidence.hourly_breakdown")).cast("long")
    return doc.select(
        "store_id", "event_date", at("daily_metrics.unique_visitors", "long").alias("unique_visitors"),
        at("daily_metrics.conversion_rate_pct", "double").alias("conversion_rate_pct"),
        F.coalesce(hours, F.lit(0)).alias("hours"), F.coalesce(at("funnel.entries", "long"), F.lit(0)).alias("entries"))


_intents = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{intent}'" for intent, words in QUESTION_KEYWORDS)
QUEST = f"""qs AS (SELECT conv_id, turn, CASE {_intents} ELSE 'general' END AS intent, printf('STORE_%03d', conv_id % 4) AS store_id,
  (SELECT strftime(min(ts) + to_days(CAST((conv_id // 4) % (date_diff('day', min(ts), max(ts)) + 1) AS INTEGER)), '%Y-%m-%d') FROM ev) AS event_date
  FROM conversations)"""


def questions(spark, sf):
    """Conversations spread over the stores and over all event days: each asks about a day of its own."""
    ends = b.events(spark, sf).agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    first, days = ends.select("first").scalar(), ends.select(F.date_diff("last", "first") + 1).scalar()
    asked = F.date_add(first, F.pmod(F.floor(F.col("conv_id") / 4), days).cast("int"))
    return b.table(spark, sf, "conversations").select(
        "conv_id", "turn", evidence.question_intent(F.col("text")).alias("intent"),
        F.format_string("STORE_%03d", F.col("conv_id") % 4).alias("store_id"), asked.alias("event_date"))


@query("question_intent", with_ctes("SELECT conv_id, turn, intent FROM qs", EV, QUEST))
def _(spark, sf):
    return questions(spark, sf).select("conv_id", "turn", "intent")


ANS = """al5 AS (SELECT store_id, count(*) AS n_alerts, string_agg(anomaly_type, ', ' ORDER BY rank) AS types,
  arg_min(anomaly_type, rank) FILTER (anomaly_type LIKE '%QUEUE%' OR anomaly_type LIKE '%CONVERSION%') AS sales_alert FROM l3 GROUP BY 1),
ans AS (SELECT conv_id, turn, intent, store_id, coalesce(data_coverage, 0) AS data_coverage, 'Rule-Based Fallback: ' || CASE
  WHEN intent = 'anomaly' THEN CASE WHEN n_alerts > 0 THEN 'Operational issues are present today: ' || types || '. Immediate inspection of affected zones is recommended.'
    ELSE 'No anomalies have been detected today. Operational parameters are running within normal historical limits.' END
  WHEN intent = 'conversion' THEN CASE WHEN sales_alert IS NOT NULL THEN 'The conversion rate is ' || r || '% with ' || c || ' purchases. A critical issue is present in the checkout funnel: ' || sales_alert || ' alert is active.'
    WHEN coalesce(abandonment_count, 0) > 5 THEN 'Today''s conversion rate is ' || r || '%. High queue abandonment (' || abandonment_count || ' checkouts abandoned) is a primary bottleneck.'
    ELSE 'Today''s conversion rate is ' || r || '%. There are ' || c || ' conversions from ' || v || ' visitors, with checkout operations running smoothly.' END
  WHEN intent = 'traffic' THEN 'Foot traffic today stands at ' || v || ' unique visitors, with an average dwell time of ' || dw || ' minutes. Traffic peaked at hour ' ||
    CASE WHEN coalesce(peak_hour, 0) = 0 THEN 'N/A' ELSE CAST(peak_hour AS VARCHAR) END || '.'
  ELSE 'Store is currently operating with ' || v || ' unique visitors, ' || r || '% conversion rate, and ' || coalesce(n_alerts, 0) || ' active anomalies.' END AS conclusion
  FROM (SELECT qs.*, data_coverage, abandonment_count, peak_hour, n_alerts, types, sales_alert, CAST(coalesce(conversion_rate_pct, 0) AS VARCHAR) AS r,
    CAST(coalesce(conversions, 0) AS VARCHAR) AS c, CAST(coalesce(unique_visitors, 0) AS VARCHAR) AS v, CAST(coalesce(avg_dwell_minutes, 0) AS VARCHAR) AS dw
    FROM qs LEFT JOIN cov USING (store_id, event_date) LEFT JOIN al5 USING (store_id)))"""


def answers(spark, sf):
    return evidence.rule_answers(questions(spark, sf), bundled(spark, sf))


@query("rule_answer", rec("SELECT conv_id, turn, intent, store_id, conclusion FROM ans", *FULL, QUEST, ANS))
def _(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", "intent", "store_id", "conclusion")


@query("answer_confidence_cap", rec("""SELECT conv_id, turn, data_coverage, CASE WHEN data_coverage = 0 THEN CAST(0 AS DOUBLE)
  WHEN data_coverage < 2 THEN CAST(0.4 AS DOUBLE) WHEN data_coverage < 3 THEN CAST(0.65 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence,
  data_coverage = 0 AS insufficient_data FROM ans""", *FULL, QUEST, ANS))
def _(spark, sf):
    return evidence.cap_confidence(answers(spark, sf)).select("conv_id", "turn", "data_coverage", "confidence", "insufficient_data")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(col: str, pick) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {_q(pick(v))}" for k, v in EXPLANATIONS.items()) + f" ELSE {_q(pick(DEFAULT_EXPLANATION))} END"


@query("anomaly_explain", rec(f"""SELECT anomaly_id, anomaly_type, {_case('anomaly_type', lambda e: e[0])} AS root_cause,
  {_case('anomaly_type', lambda e: e[1])} AS business_impact, {_case('anomaly_type', lambda e: '|'.join(e[2]))} AS recommended_actions,
  {_case('anomaly_type', lambda e: e[3])} AS priority_level FROM an""", *ANOM))
def _(spark, sf):
    return evidence.explain(anomaly_table(spark, sf)).select(
        "anomaly_id", "anomaly_type", "root_cause", "business_impact",
        F.array_join("recommended_actions", "|").alias("recommended_actions"), "priority_level")


@query("priority_normalise", """SELECT o_orderkey, CASE WHEN upper(substr(o_orderpriority, 3)) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')
  THEN upper(substr(o_orderpriority, 3)) ELSE 'MEDIUM' END AS priority FROM orders""")
def _(spark, sf):
    orders = b.table(spark, sf, "orders")
    return orders.select("o_orderkey", evidence.normalise_priority(F.substring("o_orderpriority", 3, 100)).alias("priority"))


@query("summary_prompt_fields", rec(f"""SELECT s.store_id, s.event_date, visitors, engagement, purchases, billing_joins, s.conversion_rate,
  coalesce(top_zone, 'None') AS top_zone, coalesce(worst_zone, 'None') AS worst_zone,
  printf('%.1f', {rnd('s.avg_dwell_seconds', 1)}) AS avg_dwell_seconds, coalesce(oa, 0) AS active_anomalies_count
  FROM smc s LEFT JOIN bw USING (store_id, event_date) LEFT JOIN (SELECT store_id, count(*) AS oa FROM an WHERE NOT is_resolved GROUP BY 1) USING (store_id)""",
    *ANOM, SUMMARY, BESTWORST))
def _(spark, sf):
    ev = b.events(spark, sf)
    counts = funnel.summary_counts(ev, rollups.event_dwell(ev))
    return evidence.summary_fields(counts, heatmap.best_worst_zone(ev), anomaly_table(spark, sf))


RICH = f"""rich AS (SELECT store_id, event_date, stage_order, CASE stage_order WHEN 0 THEN 'ENTRY' WHEN 1 THEN 'ENGAGEMENT' WHEN 2 THEN 'BILLING' ELSE 'PURCHASE' END AS stage_id,
  "count" AS visitors, prev AS prev_visitors, entries,
  CASE WHEN stage_order = 0 THEN CAST(100 AS DOUBLE) WHEN entries > 0 THEN {rnd('CAST("count" AS DOUBLE) / entries * 100', 1)} ELSE 0 END AS conversion_rate,
  CASE WHEN stage_order = 0 THEN CAST(0 AS DOUBLE) WHEN prev > 0 THEN {rnd('CAST(prev - "count" AS DOUBLE) / prev * 100', 1)} ELSE 0 END AS dropoff_rate,
  CASE WHEN stage_order = 0 THEN 0 ELSE greatest(0, prev - "count") END AS lost_users
  FROM (SELECT *, lag("count") OVER w AS prev, first_value("count") OVER w AS entries FROM fs WINDOW w AS (PARTITION BY store_id, event_date ORDER BY stage_order)))"""
RICHS = (EV, STAGES, FSTAGES, RICH)


def rich(spark, sf):
    return insight.funnel_rich(funnel.funnel_stages(funnel.store_day_funnel(b.events(spark, sf))))


@query("funnel_rich", with_ctes("SELECT store_id, event_date, stage_id, visitors, conversion_rate, dropoff_rate, lost_users FROM rich", *RICHS))
def _(spark, sf):
    return rich(spark, sf).select("store_id", "event_date", "stage_id", "visitors", "conversion_rate", "dropoff_rate", "lost_users")


@query("stage_status", with_ctes("""SELECT store_id, event_date, stage_id, CASE stage_id WHEN 'ENTRY' THEN 'healthy'
  WHEN 'ENGAGEMENT' THEN CASE WHEN entries > 0 AND CAST(visitors AS DOUBLE) / entries >= 0.7 THEN 'healthy' WHEN entries > 0 AND CAST(visitors AS DOUBLE) / entries >= 0.6 THEN 'watch' ELSE 'attention' END
  WHEN 'BILLING' THEN CASE WHEN prev_visitors > 0 AND CAST(prev_visitors - visitors AS DOUBLE) / prev_visitors > 0.45 THEN 'critical' ELSE 'attention' END
  ELSE CASE WHEN entries > 0 AND CAST(visitors AS DOUBLE) / entries >= 0.25 THEN 'healthy' ELSE 'watch' END END AS status FROM rich""", *RICHS))
def _(spark, sf):
    return insight.stage_status(rich(spark, sf)).select("store_id", "event_date", "stage_id", "status")


KPI = f"""wk AS (SELECT store_id, event_date, max(entries) AS visitors, max(visitors) FILTER (stage_id = 'PURCHASE') AS purchases,
  max(conversion_rate) FILTER (stage_id = 'PURCHASE') AS conversion_rate, arg_min(stage_id, (-lost_users, stage_order)) AS critical_stage,
  max(lost_users) AS lost_users, arg_min(conversion_rate, (-lost_users, stage_order)) AS stage_rate FROM rich GROUP BY 1, 2)"""


@query("funnel_kpis", with_ctes(f"""SELECT store_id, event_date, visitors, purchases, conversion_rate, critical_stage, purchases * CAST(1650 AS DOUBLE) AS revenue,
  CAST({rnd('(visitors - purchases) * CAST(1650 AS DOUBLE) * CAST(0.35 AS DOUBLE)', 0)} AS BIGINT) AS lost_revenue FROM wk""", *RICHS, KPI))
def _(spark, sf):
    return insight.funnel_kpis(rich(spark, sf))


def _stage_case(table: dict, kind: str = "text") -> str:
    return "CASE critical_stage " + " ".join(
        f"WHEN '{k}' THEN " + (_q(v) if kind == "text" else f"CAST({v} AS DOUBLE)") for k, v in table.items()) + " END"


@query("funnel_insight", with_ctes(f"""SELECT store_id, event_date, critical_stage AS stage_id, lost_users, stage_rate AS conversion_rate,
  CAST({rnd('lost_users * CAST(1650 AS DOUBLE) * CAST(0.35 AS DOUBLE)', 0)} AS BIGINT) AS lost_revenue, {_stage_case(STAGE_CAUSES)} AS cause,
  {_stage_case(STAGE_RECOMMENDATIONS)} AS recommendation, {_stage_case(STAGE_BENCHMARKS, 'num')} AS benchmark,
  stage_rate < {_stage_case(STAGE_BENCHMARKS, 'num')} AS below_benchmark FROM wk""", *RICHS, KPI))
def _(spark, sf):
    return insight.funnel_insight(rich(spark, sf))


def _mean(days: int) -> str:
    return f"""avg(conversion_rate) OVER (PARTITION BY store_id, stage_id ORDER BY CAST(event_date AS DATE)
    RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"""


@query("funnel_period_compare", with_ctes(f"""SELECT store_id, event_date, stage_id, conversion_rate,
  {rnd('conversion_rate - ' + rnd(_mean(1), 6), 1)} AS vs_yesterday, {rnd('conversion_rate - ' + rnd(_mean(7), 6), 1)} AS vs_7d,
  {rnd('conversion_rate - ' + rnd(_mean(30), 6), 1)} AS vs_30d FROM rich""", *RICHS))
def _(spark, sf):
    return insight.period_compare(rich(spark, sf))


@query("hour_label", with_ctes("SELECT store_id, hour_bucket, strftime(hour_bucket, '%H:00') AS hour, unique_visitors FROM hourly", EV, TX, SESS, HOURLY))
def _(spark, sf):
    return d.hourly_table(spark, sf).select("store_id", "hour_bucket", hour_label(F.col("hour_bucket")).alias("hour"), "unique_visitors")


_labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FUNNEL_STAGES)


@query("stage_label", with_ctes(f"""SELECT store_id, event_date, stage, CASE stage {_labels} END AS label, "count" FROM fs""", EV, STAGES, FSTAGES))
def _(spark, sf):
    return funnel.funnel_stages(funnel.store_day_funnel(b.events(spark, sf))).select(
        "store_id", "event_date", "stage", stage_label(F.col("stage")).alias("label"), "count")
