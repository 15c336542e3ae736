"""Business constants, one frozen dataclass per concern."""

from dataclasses import dataclass


@dataclass(frozen=True)
class PosConfig:
    window_seconds: int = 300
    fallback_billing_zone: str = "Z_BILLING"
    purchase_camera: str = "CAM_03"


@dataclass(frozen=True)
class QueueConfig:
    density_threshold: int = 3
    abandon_seconds: int = 120


@dataclass(frozen=True)
class AnomalyConfig:
    z_threshold: float = 2.5
    lookback_days: int = 7
    min_baseline: int = 3
    dead_zone_minutes: int = 30
    suppress_seconds: int = 2 * 3600
    dead_zone_suppress_seconds: int = 3600


@dataclass(frozen=True)
class HealthConfig:
    stale_seconds: float = 600.0


@dataclass(frozen=True)
class ReidConfig:
    threshold: float = 0.65
    window_seconds: int = 1800
    reentry_min_seconds: int = 300
    gallery_recent: int = 5
    gallery_cap: int = 10
    weights: tuple[float, float, float] = (0.6, 0.2, 0.2)
    weights_no_embedding: tuple[float, float, float] = (0.0, 0.5, 0.5)


@dataclass(frozen=True)
class StaffConfig:
    weights: tuple[float, float, float, float] = (0.35, 0.25, 0.25, 0.15)
    threshold: float = 0.75
    open_hour: int = 9
    close_hour: int = 21
    dwell_hours: float = 3.0
    total_zones: int = 6
    repeat_days: float = 5.0


@dataclass(frozen=True)
class DetectionConfig:
    min_confidence: float = 0.35
    min_area: float = 400.0
    iou_threshold: float = 0.3
    high_confidence: float = 0.6
    min_hits: int = 5
    max_lost_frames: int = 90
    history: int = 30
    target_fps: int = 5


@dataclass(frozen=True)
class HeatmapConfig:
    min_sessions: int = 20
    min_zone_dwell_seconds: float = 5.0
    dwell_scale: float = 500.0
    visitor_scale: float = 1000.0


@dataclass(frozen=True)
class BatchConfig:
    max_events: int = 500
    max_store_id: int = 64
    max_visitor_id: int = 128


LOST_REVENUE_INTENT = 0.35
