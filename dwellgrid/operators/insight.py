"""Dashboard funnel: percentages, status, KPIs, worst stage and period comparison.

Windows run over the four stages of a store and day, or over the days of one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.config import LOST_REVENUE_INTENT
from dwellgrid.fixed_values import STAGE_BENCHMARKS, STAGE_CAUSES, STAGE_RECOMMENDATIONS
from dwellgrid.functions.labels import lookup
from dwellgrid.operators.funnel import DAY

DEFAULT_ARPU = 1650.0
RICH_IDS = ("ENTRY", "ENGAGEMENT", "BILLING", "PURCHASE")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / F.when(whole > 0, whole) * 100, 1)).otherwise(0.0)


def funnel_rich(stages: DataFrame) -> DataFrame:
    """Per stage: share of entries, drop-off and visitors lost against the stage before."""
    w = Window.partitionBy(*DAY).orderBy("stage_order")
    count, prev = F.col("count"), F.col("prev")
    base = stages.select(
        *DAY, "stage_order", F.element_at(F.array(*[F.lit(s) for s in RICH_IDS]), F.col("stage_order") + 1).alias("stage_id"),
        "count", F.lag("count").over(w).alias("prev"), F.first("count").over(w).alias("entries"),
    )
    first = F.col("stage_order") == 0
    return base.select(
        *DAY, "stage_order", "stage_id", count.alias("visitors"), prev.alias("prev_visitors"), "entries",
        F.when(first, 100.0).otherwise(_percent(count, F.col("entries"))).alias("conversion_rate"),
        F.when(first, 0.0).otherwise(_percent(prev - count, prev)).alias("dropoff_rate"),
        F.when(first, 0).otherwise(F.greatest(F.lit(0), prev - count)).cast("long").alias("lost_users"),
    )


def stage_status(rich: DataFrame) -> DataFrame:
    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(0.0)

    of_entry = ratio(F.col("visitors"), F.col("entries"))
    dropped = ratio(F.col("prev_visitors") - F.col("visitors"), F.col("prev_visitors"))
    sid = F.col("stage_id")
    status = (
        F.when(sid == "ENTRY", "healthy")
        .when(sid == "ENGAGEMENT", F.when(of_entry >= 0.7, "healthy").when(of_entry >= 0.6, "watch").otherwise("attention"))
        .when(sid == "BILLING", F.when(dropped > 0.45, "critical").otherwise("attention"))
        .otherwise(F.when(of_entry >= 0.25, "healthy").otherwise("watch"))
    )
    return rich.withColumn("status", status)


def _worst(value: Column) -> Column:
    """Value at the stage with most lost visitors; the earlier stage on a tie."""
    return F.max_by(value, F.struct("lost_users", -F.col("stage_order")))


def funnel_kpis(rich: DataFrame, arpu: float = DEFAULT_ARPU) -> DataFrame:
    purchases = F.max(F.when(F.col("stage_id") == "PURCHASE", F.col("visitors")))
    rate = F.max(F.when(F.col("stage_id") == "PURCHASE", F.col("conversion_rate")))
    out = rich.groupBy(*DAY).agg(
        F.max("entries").alias("visitors"), purchases.alias("purchases"), rate.alias("conversion_rate"),
        _worst(F.col("stage_id")).alias("critical_stage"),
    )
    lost = F.round((F.col("visitors") - F.col("purchases")) * arpu * LOST_REVENUE_INTENT).cast("long")
    return out.withColumn("revenue", F.col("purchases") * arpu).withColumn("lost_revenue", lost)


def funnel_insight(rich: DataFrame, arpu: float = DEFAULT_ARPU) -> DataFrame:
    worst = rich.groupBy(*DAY).agg(
        _worst(F.struct("stage_id", "lost_users", "conversion_rate")).alias("w")
    ).select(*DAY, "w.*")
    sid = F.col("stage_id")
    benchmark = lookup(sid, STAGE_BENCHMARKS)
    return worst.select(
        *DAY, "stage_id", "lost_users", "conversion_rate",
        F.round(F.col("lost_users") * arpu * LOST_REVENUE_INTENT).cast("long").alias("lost_revenue"),
        lookup(sid, STAGE_CAUSES).alias("cause"), lookup(sid, STAGE_RECOMMENDATIONS).alias("recommendation"),
        benchmark.alias("benchmark"), (F.col("conversion_rate") < benchmark).alias("below_benchmark"),
    )


def period_compare(rich: DataFrame) -> DataFrame:
    """Points gained or lost against the day before and the means of the last 7 and 30 calendar days; a closed day is
    no yesterday."""
    w = Window.partitionBy("store_id", "stage_id").orderBy(F.unix_date("event_date"))
    rate = F.col("conversion_rate")

    def against(days: int) -> Column:
        return F.round(rate - F.round(F.avg(rate).over(w.rangeBetween(-days, -1)), 6), 1)

    return rich.select(
        *DAY, "stage_id", "conversion_rate", against(1).alias("vs_yesterday"), against(7).alias("vs_7d"),
        against(30).alias("vs_30d"),
    )
