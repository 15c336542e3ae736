"""Evidence per store and day, and rule-based answers and explanations built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.fixed_values import (
    ANSWER_LEAD, CONCLUSIONS, DEFAULT_EXPLANATION, EXPLANATIONS, OBSERVATIONS, PRIORITIES, QUESTION_KEYWORDS,
)
from dwellgrid.functions.labels import fill, title_case
from dwellgrid.operators.funnel import DAY, not_staff

ANSWER_CONFIDENCE = 0.85
ABANDON_ALERT = 5


def evidence_daily(daily: DataFrame) -> DataFrame:
    return daily.select(
        *DAY, "unique_visitors", "conversions",
        F.round(F.col("conversion_rate") * 100, 1).alias("conversion_rate_pct"),
        F.round(F.col("avg_dwell_seconds") / 60, 1).alias("avg_dwell_minutes"),
        "peak_hour", "max_queue_depth", "abandonment_count", "total_revenue",
    )


def evidence_hourly(hourly: DataFrame) -> DataFrame:
    """Hours of each day in order (24 at most per list)."""
    item = F.struct(
        F.hour("hour_bucket").alias("hour"), F.col("unique_visitors").alias("visitors"), "conversions",
        F.col("max_queue_depth").alias("queue_depth"),
    )
    return hourly.groupBy("store_id", F.to_date("hour_bucket").alias("event_date")).agg(
        F.sort_array(F.collect_list(item)).alias("hourly_breakdown")
    )


def evidence_anomalies(anomalies: DataFrame, limit: int = 5) -> DataFrame:
    """Newest unresolved alerts per store; the rank limit applies before the shuffle."""
    w = Window.partitionBy("store_id").orderBy(F.desc("detected_at"), "anomaly_type", "affected_zone_id")
    newest = anomalies.where(~F.col("is_resolved")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return newest.select(
        "store_id", "rank", "anomaly_type", "severity", "metric_value", "baseline_value", F.round("z_score", 2).alias("z_score")
    )


def anomaly_lists(newest: DataFrame) -> DataFrame:
    item = F.struct("rank", "anomaly_type", "severity", "metric_value", "baseline_value", "z_score")
    return newest.groupBy("store_id").agg(F.sort_array(F.collect_list(item)).alias("active_anomalies"))


def evidence_funnel(events: DataFrame) -> DataFrame:
    """Distinct customer sessions that entered, engaged and abandoned."""
    def flag(t: str) -> Column:
        return F.max(F.when(F.col("event_type") == t, 1).otherwise(0))

    per_session = not_staff(events).groupBy(*DAY, "session_id").agg(
        flag("ENTRY").alias("e"), flag("ZONE_ENTER").alias("z"), flag("BILLING_QUEUE_ABANDON").alias("a")
    )
    return per_session.groupBy(*DAY).agg(
        F.sum("e").alias("entries"), F.sum("z").alias("zone_engagements"), F.sum("a").alias("queue_abandonments")
    )


def bundle(daily: DataFrame, hourly: DataFrame, newest: DataFrame, funnel: DataFrame) -> DataFrame:
    """All evidence of a store and day side by side, with the number of parts present (0 to 4)."""
    fields = [c for c in daily.columns if c not in DAY]
    parts = daily.select(*DAY, F.struct(*fields).alias("daily_metrics"))
    parts = parts.join(hourly, DAY, "full")
    seen = funnel.where(F.col("entries") > 0)
    parts = parts.join(
        seen.select(*DAY, F.struct("entries", "zone_engagements", "queue_abandonments").alias("funnel")), DAY, "full"
    )
    parts = parts.join(anomaly_lists(newest), "store_id", "left")
    present = [F.col(c).isNotNull().cast("int") for c in ("daily_metrics", "hourly_breakdown", "active_anomalies", "funnel")]
    return parts.withColumn("data_coverage", present[0] + present[1] + present[2] + present[3])


def evidence_json(bundled: DataFrame) -> DataFrame:
    doc = F.to_json(F.struct(
        "store_id", F.col("event_date").cast("string").alias("analysis_date"),
        F.struct("daily_metrics", "hourly_breakdown", "active_anomalies", "funnel").alias("evidence"),
    ))
    return bundled.select(*DAY, doc.alias("document"))


def question_intent(text: Column) -> Column:
    """First intent, in fixed order, with a keyword anywhere in the question."""
    lowered, out = F.lower(text), None
    for intent, words in QUESTION_KEYWORDS:
        hit = lowered.rlike("|".join(words))
        out = F.when(hit, intent) if out is None else out.when(hit, intent)
    return out.otherwise("general")


def rule_answers(questions: DataFrame, bundled: DataFrame) -> DataFrame:
    """Answer per question from the evidence of its store and day; ``questions`` has an intent column."""
    q = questions.join(bundled, DAY, "left")

    def metric(name: str, default) -> Column:
        return F.coalesce(F.col(f"daily_metrics.{name}"), F.lit(default))

    def text(c: Column) -> Column:
        return c.cast("string")

    alerts = F.coalesce("active_anomalies", F.array().cast(bundled.schema["active_anomalies"].dataType))
    sales_alert = F.try_element_at(
        F.filter(alerts, lambda a: a["anomaly_type"].contains("QUEUE") | a["anomaly_type"].contains("CONVERSION")), F.lit(1)
    )
    abandoned, peak = metric("abandonment_count", 0), F.col("daily_metrics.peak_hour")
    known = {
        "visitors": text(metric("unique_visitors", 0)), "sales": text(metric("conversions", 0)),
        "rate": text(metric("conversion_rate_pct", 0.0)), "dwell": text(metric("avg_dwell_minutes", 0.0)),
        "queue": text(metric("max_queue_depth", 0)), "abandoned": text(abandoned), "n_alerts": text(F.size(alerts)),
        "types": F.array_join(F.transform(alerts, lambda a: a["anomaly_type"]), ", "), "peak": text(peak),
        "peak_or_na": F.when(F.coalesce(peak, F.lit(0)) == 0, "N/A").otherwise(text(peak)),
        "sales_alert": sales_alert["anomaly_type"], "sales_severity": sales_alert["severity"],
    }
    has_alerts, has_sales_alert = F.size(alerts) > 0, sales_alert.isNotNull()

    def told(name: str) -> Column:
        return fill(ANSWER_LEAD + CONCLUSIONS[name], known)

    def noted(name: str) -> list[Column]:
        lines = OBSERVATIONS[name]
        return [fill(line, known) for line in ((lines,) if isinstance(lines, str) else lines)]

    def alert_line(a: Column) -> Column:
        return fill(OBSERVATIONS["alert_line"], {
            "rank": text(a["rank"]), "type": title_case(F.lower(a["anomaly_type"])), "severity": a["severity"],
            "metric": text(a["metric_value"]), "baseline": text(a["baseline_value"]), "z": text(a["z_score"]),
        })

    intent = F.col("intent")
    conclusion = (
        F.when((intent == "anomaly") & has_alerts, told("alerts")).when(intent == "anomaly", told("no_alerts"))
        .when((intent == "conversion") & has_sales_alert, told("sales_alert"))
        .when((intent == "conversion") & (abandoned > ABANDON_ALERT), told("abandonment"))
        .when(intent == "conversion", told("smooth")).when(intent == "traffic", told("traffic")).otherwise(told("general"))
    )
    observations = (
        F.when((intent == "anomaly") & has_alerts, F.concat(F.array(*noted("alerts")), F.transform(alerts, alert_line)))
        .when(intent == "anomaly", F.array(*noted("no_alerts")))
        .when(intent == "conversion", F.array_compact(F.array(*noted("conversion"), *noted("sales_alert"))))
        .when(intent == "traffic", F.array_compact(F.array(*noted("traffic"), *noted("peak"))))
        .otherwise(F.array(*noted("general")))
    )
    return q.select(
        *questions.columns, F.coalesce("data_coverage", F.lit(0)).alias("data_coverage"),
        conclusion.alias("conclusion"), observations.alias("observations"), F.lit(ANSWER_CONFIDENCE).alias("confidence"),
    )


def cap_confidence(answers: DataFrame) -> DataFrame:
    """Caps the confidence by coverage; without evidence, observations or conclusion the answer is insufficient."""
    capped = (
        F.when(F.col("data_coverage") < 2, F.least("confidence", F.lit(0.4)))
        .when(F.col("data_coverage") < 3, F.least("confidence", F.lit(0.65))).otherwise(F.col("confidence"))
    )
    empty = (
        (F.col("data_coverage") == 0) | (F.size("observations") == 0) | (F.length("conclusion") == 0)
    )
    flagged = F.upper("conclusion").contains("INSUFFICIENT_DATA")
    return answers.withColumn("confidence", F.when(empty, 0.0).otherwise(capped)).withColumn("insufficient_data", empty | flagged)


def normalise_priority(priority: Column) -> Column:
    upper = F.upper(priority)
    return F.when(upper.isin(*PRIORITIES), upper).otherwise("MEDIUM")


def explain(anomalies: DataFrame) -> DataFrame:
    """Root cause, impact, actions and priority per alert, with a default for unknown types."""
    def entry(e) -> Column:
        return F.struct(
            F.lit(e[0]).alias("root_cause"), F.lit(e[1]).alias("business_impact"),
            F.array(*[F.lit(a) for a in e[2]]).alias("recommended_actions"), F.lit(e[3]).alias("priority_level"),
        )

    table = F.create_map(*[x for k, v in EXPLANATIONS.items() for x in (F.lit(k), entry(v))])
    told = F.coalesce(F.try_element_at(table, F.col("anomaly_type")), entry(DEFAULT_EXPLANATION))
    return anomalies.withColumn("_e", told).select("*", "_e.*").drop("_e")


def summary_fields(counts: DataFrame, zones: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Fields of a store summary: counts of the day, best and worst zone, open alerts of the store."""
    open_alerts = anomalies.where(~F.col("is_resolved")).groupBy("store_id").agg(F.count("*").alias("active_anomalies_count"))
    return counts.join(zones, DAY, "left").join(open_alerts, "store_id", "left").select(
        *DAY, "visitors", "engagement", "purchases", "billing_joins", "conversion_rate",
        F.coalesce("top_zone", F.lit("None")).alias("top_zone"), F.coalesce("worst_zone", F.lit("None")).alias("worst_zone"),
        F.format_string("%.1f", F.round("avg_dwell_seconds", 1)).alias("avg_dwell_seconds"),
        F.coalesce("active_anomalies_count", F.lit(0)).alias("active_anomalies_count"),
    )
