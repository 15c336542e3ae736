"""Display labels and lookups from fixed values."""

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellgrid.fixed_values import FUNNEL_STAGES


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """Constant map lookup; null for unknown keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """Text with the named placeholders replaced by columns."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def title_case(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def stage_label(code: Column) -> Column:
    spaced = F.replace(code, F.lit("_"), F.lit(" "))
    first_upper = F.array_join(
        F.transform(F.split(spaced, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " "
    )
    return F.coalesce(lookup(code, dict(FUNNEL_STAGES)), first_upper)


def hour_label(bucket: Column) -> Column:
    return F.date_format(bucket, "HH:00")


def lag_label(seconds: Column) -> Column:
    def whole(x: Column) -> Column:
        return F.round(x).cast("long").cast("string")

    return (
        F.when(seconds.isNull(), "No events")
        .when(seconds < 60, F.concat(whole(seconds), F.lit("s ago")))
        .when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m ago")))
        .otherwise(F.concat(whole(seconds / 3600), F.lit("h ago")))
    )


def score_tier(score: Column) -> Column:
    return F.when(score == 0, "idle").when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def severity_class(severity: Column) -> Column:
    upper = F.upper(severity)
    return F.when(upper == "CRITICAL", "CRITICAL").when(upper.isin("HIGH", "MEDIUM"), "WARN").otherwise("INFO")
