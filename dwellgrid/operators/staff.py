"""Staff detection from visitor profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.config import StaffConfig
from dwellgrid.functions.scoring import exact_sum, staff_score
from dwellgrid.session import broadcast_if_small

VISITOR = ["store_id", "visitor_id"]


def visitor_profile(events: DataFrame, dwell_seconds: Column, cfg: StaffConfig = StaffConfig()) -> DataFrame:
    """Per visitor: span, total dwell, zones, days, presence near opening and closing.

    The sets hold zones of a floor plan and calendar days, so they stay small for any number of events.
    """
    def near(hour: int) -> Column:
        return F.bool_or(F.abs(F.hour("ts") - hour) <= 1)

    return events.groupBy(*VISITOR).agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.coalesce(exact_sum(dwell_seconds), F.lit(0.0)).alias("total_dwell_seconds"),
        F.size(F.collect_set("zone_id")).alias("zones"), F.size(F.collect_set(F.to_date("ts"))).alias("days"),
        near(cfg.open_hour).alias("seen_at_open"), near(cfg.close_hour).alias("seen_at_close"),
    )


def staff_scores(profiles: DataFrame, cfg: StaffConfig = StaffConfig()) -> DataFrame:
    score = staff_score(
        F.col("total_dwell_seconds"), F.col("zones"), F.col("days"), F.col("seen_at_open"), F.col("seen_at_close"), cfg
    )
    return profiles.withColumn("staff_score", score)


def staff_members(scores: DataFrame, cfg: StaffConfig = StaffConfig()) -> DataFrame:
    return scores.where(F.col("staff_score") >= cfg.threshold).select(*VISITOR, "staff_score")


def mark_staff(events: DataFrame, staff: DataFrame) -> DataFrame:
    """Events with ``is_staff`` taken from the staff list."""
    listed = broadcast_if_small(staff.select(*VISITOR, F.lit(True).alias("_s")))
    return events.drop("is_staff").join(listed, VISITOR, "left").withColumn(
        "is_staff", F.coalesce("_s", F.lit(False))
    ).drop("_s")
