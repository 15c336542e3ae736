"""Scores used by identity matching, staff detection and anomaly detection."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellgrid.config import AnomalyConfig, ReidConfig, StaffConfig
from dwellgrid.functions.geometry import box_iou


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def calibrated_confidence(c: Column) -> Column:
    return F.round(1 / (1 + F.exp(-(c - 0.5) * 10 * 1.2)), 4)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def normalised(v: Column) -> Column:
    norm = F.array(F.sqrt(dot(v, v)) + 1e-8)  # an argument of the outer lambda, so it is computed once a vector
    return F.transform(norm, lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def appearance_score(query: Column, gallery: Column, cfg: ReidConfig = ReidConfig()) -> Column:
    """0.7 max + 0.3 mean of the dot products with the newest gallery entries."""
    newest = F.slice(gallery, -F.least(F.size(gallery), F.lit(cfg.gallery_recent)), cfg.gallery_recent)
    sims = F.transform(newest, lambda e: dot(query, e))
    mean = F.aggregate(sims, F.lit(0.0), lambda acc, v: acc + v) / F.size(sims)
    return F.when(query.isNotNull() & (F.size(gallery) > 0), F.array_max(sims) * 0.7 + mean * 0.3).otherwise(0.0)


def temporal_score(gap_seconds: Column, cfg: ReidConfig = ReidConfig()) -> Column:
    scale = cfg.window_seconds / 3
    return F.when(F.abs(gap_seconds) <= cfg.window_seconds, F.exp(-F.abs(gap_seconds) / scale)).otherwise(0.0)


def trajectory_score(box: Column, last_box: Column, same_camera: Column) -> Column:
    """Overlap with the last box, halved across cameras; a missing box scores 0."""
    return F.coalesce(box_iou(box, last_box) * F.when(same_camera, 1.0).otherwise(0.5), F.lit(0.0))


def reid_score(
    appearance: Column, temporal: Column, trajectory: Column, has_embedding: Column, cfg: ReidConfig = ReidConfig()
) -> Column:
    def weighted(w: tuple[float, float, float]) -> Column:
        return w[0] * appearance + w[1] * temporal + w[2] * trajectory

    raw = F.when(has_embedding, weighted(cfg.weights)).otherwise(weighted(cfg.weights_no_embedding))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def staff_score(
    dwell_seconds: Column, zones: Column, days: Column, at_open: Column, at_close: Column,
    cfg: StaffConfig = StaffConfig(),
) -> Column:
    one = F.lit(1.0)
    w = cfg.weights
    hours = F.least(one, dwell_seconds / 3600 / cfg.dwell_hours)
    coverage = F.least(one, zones / cfg.total_zones)
    repeat = F.least(one, (days - 1) / cfg.repeat_days)
    edges = F.when(at_open, 0.5).otherwise(0.0) + F.when(at_close, 0.5).otherwise(0.0)
    return F.round(w[0] * hours + w[1] * coverage + w[2] * repeat + w[3] * edges, 4)


def zscore(n: Column, mean: Column, std: Column, x: Column, cfg: AnomalyConfig) -> Column:
    """z of ``x``; null below the minimum baseline or with no spread (single-point baselines use a floor)."""
    floor = F.greatest(F.lit(1.0), 0.1 * mean) if cfg.min_baseline == 1 else F.lit(None).cast("double")
    spread = F.when(std < 1e-6, floor).otherwise(std)
    return F.when(n >= cfg.min_baseline, (x - mean) / spread)


def severity(z: Column) -> Column:
    return F.when(F.abs(z) >= 3.0, "CRITICAL").when(F.abs(z) >= 2.8, "HIGH").otherwise("MEDIUM")


def anomaly_confidence(z: Column, n: Column) -> Column:
    """Grows with |z| (to 5) and with the number of baseline points (to 14)."""
    strength = (F.least(F.abs(z), F.lit(5.0)) - 2.5) / 2.5
    return F.round(F.least(F.lit(1.0), F.least(F.lit(1.0), n / 14) * strength), 3)


def exact_sum(value: Column) -> Column:
    """Sum that does not depend on the order of rows: decimals wide enough to keep a double's digits inside, double
    outside. Where a value or the sum does not fit them, the plain sum of the doubles."""
    wide = value.try_cast("decimal(38,16)")
    whole = F.when(F.count(wide) == F.count(value), F.try_sum(wide).cast("double"))
    return F.coalesce(whole, F.sum(value))


def exact_avg(value: Column) -> Column:
    return exact_sum(value) / F.count(value)
