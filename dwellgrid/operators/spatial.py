"""Zone assignment, box overlap and tracklets over camera detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.config import DetectionConfig
from dwellgrid.functions.geometry import box_iou, foot_x, foot_y, in_bounds, inside_edges, polygon_bounds, polygon_edges
from dwellgrid.functions.scoring import exact_avg
from dwellgrid.operators.matching import priority_match
from dwellgrid.operators.ordered import OrderedRows
from dwellgrid.session import broadcast_if_small

TRACK = ["store_id", "camera_id", "track_id"]
CELL = 128.0


def with_foot_point(detections: DataFrame) -> DataFrame:
    return detections.withColumn("foot_x", foot_x(F.col("bbox"))).withColumn("foot_y", foot_y(F.col("bbox")))


def floor_plans(zones: DataFrame) -> DataFrame:
    """One row per store with its zones, highest priority first (a floor plan is a small list)."""
    item = F.struct(
        (-F.col("priority")).alias("p"), "zone_ord", "zone_id", "zone_type",
        polygon_bounds(F.col("polygon")).alias("bounds"), polygon_edges(F.col("polygon")).alias("edges"),
    )
    return zones.groupBy("store_id").agg(F.sort_array(F.collect_list(item)).alias("plan"))


def zone_assign(detections: DataFrame, zones: DataFrame) -> DataFrame:
    """First zone by priority that holds the foot point; null when none does. One row in, one row out."""
    placed = with_foot_point(detections).join(broadcast_if_small(floor_plans(zones)), "store_id", "left")
    x, y = F.col("foot_x"), F.col("foot_y")
    close = F.filter("plan", lambda z: in_bounds(x, y, z["bounds"]))
    hit = F.try_element_at(F.filter(close, lambda z: inside_edges(x, y, z["edges"])), F.lit(1))
    return placed.select(*detections.columns, "foot_x", "foot_y", hit["zone_id"].alias("zone_id"))


def zones_of_type(zones: DataFrame, *types: str) -> DataFrame:
    return zones.where(F.col("zone_type").isin(*types)) if types else zones


def consecutive_iou(detections: DataFrame) -> DataFrame:
    """Overlap of each detection with the previous box of its track."""
    rows = OrderedRows.of(
        detections.select(*TRACK, "ts", "detection_id", "bbox"), TRACK, ["ts", "detection_id"]
    ).lag({"prev_bbox": "bbox"}).result()
    return rows.where(F.col("prev_bbox").isNotNull()).withColumn("iou", box_iou(F.col("bbox"), F.col("prev_bbox")))


def _cells(box: Column) -> Column:
    def span(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / CELL), F.floor(hi / CELL))

    xs, ys = span(box["x1"], box["x2"]), span(box["y1"], box["y2"])
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def overlapping_boxes(left: DataFrame, right: DataFrame, keys: list[str], min_iou: float) -> DataFrame:
    """Pairs of boxes with enough overlap, by an equi-join on keys and grid cell.

    Boxes that share no cell never meet. A pair sharing several cells is kept only in the cell of the
    upper left corner of its intersection, so no distinct is needed.
    """
    a = left.select(*keys, "detection_id", F.col("bbox").alias("a"), "confidence", F.explode(_cells(F.col("bbox"))).alias("cell"))
    b = right.select(*keys, F.col("detection_id").alias("prev_id"), F.col("bbox").alias("b"), F.explode(_cells(F.col("bbox"))).alias("cell"))
    pairs = a.join(b, [*keys, "cell"])
    home = F.struct(
        F.floor(F.greatest("a.x1", "b.x1") / CELL).alias("cx"), F.floor(F.greatest("a.y1", "b.y1") / CELL).alias("cy")
    )
    return pairs.where(F.col("cell") == home).withColumn("iou", box_iou(F.col("a"), F.col("b"))).where(
        F.col("iou") >= min_iou
    ).select(*keys, "detection_id", "prev_id", "confidence", "iou")


def frame_iou_match(detections: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """One-to-one links to the previous frame: confident detections choose first, each the best free box."""
    keys = ["store_id", "camera_id", "frame_idx"]
    current = detections.select(*keys, "detection_id", "bbox", "confidence")
    previous = current.withColumn("frame_idx", F.col("frame_idx") + 1)
    pairs = overlapping_boxes(current, previous, keys, cfg.iou_threshold)
    ranked = pairs.select(
        *keys, "detection_id", "prev_id", "iou", (F.col("confidence") < cfg.high_confidence).alias("late"),
        (-F.col("confidence")).alias("turn"), (-F.col("iou")).alias("wish"),
    )
    order = ["late", "turn", "detection_id", "wish", "prev_id"]
    return priority_match(ranked, keys, "detection_id", "prev_id", order, ["iou"])


def predict_position(detections: DataFrame) -> DataFrame:
    """Next box by continuing the last step; the box itself when the track has one sighting."""
    rows = OrderedRows.of(
        detections.select(*TRACK, "ts", "detection_id", "bbox"), TRACK, ["ts", "detection_id"]
    ).lag({"prev_bbox": "bbox"}).result()
    zero = F.lit(0.0)
    step = {"x": F.coalesce(F.col("bbox.x1") - F.col("prev_bbox.x1"), zero),
            "y": F.coalesce(F.col("bbox.y1") - F.col("prev_bbox.y1"), zero)}
    parts = [(F.col(f"bbox.{c}") + step[c[0]]).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return rows.select(*TRACK, "ts", "detection_id", F.struct(*parts).alias("predicted"))


def track_summary(detections: DataFrame) -> DataFrame:
    return detections.groupBy(*TRACK).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("hits"),
        exact_avg(F.col("confidence")).alias("avg_confidence"),
        F.max_by("bbox", F.struct("ts", "detection_id")).alias("last_bbox"),
    )


def track_state(detections: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """State of each track generation at the end of its feed; a silence over the limit ends a generation."""
    gap = F.col("frame_idx") - F.col("prev_frame")
    fresh = F.when(F.col("prev_frame").isNull() | (gap > cfg.max_lost_frames), 1).otherwise(0)
    rows = (
        OrderedRows.of(detections.select(*TRACK, "frame_idx", "detection_id"), TRACK, ["frame_idx", "detection_id"])
        .lag({"prev_frame": "frame_idx"}).running_sum("generation", fresh).result()
    )
    lives = rows.groupBy(*TRACK, F.col("generation").cast("long").alias("generation")).agg(
        F.count("*").alias("hits"), F.max("frame_idx").alias("last_frame")
    )
    feed_end = detections.groupBy("store_id", "camera_id").agg(F.max("frame_idx").alias("feed_frame"))
    silent = F.col("feed_frame") - F.col("last_frame")
    confirmed = F.col("hits") >= cfg.min_hits
    state = (
        F.when(silent > cfg.max_lost_frames, "DELETED")
        .when(confirmed & (silent > 0), "LOST").when(confirmed, "CONFIRMED").otherwise("TENTATIVE")
    )
    return lives.join(broadcast_if_small(feed_end), ["store_id", "camera_id"]).select(
        *TRACK, "generation", "hits", "last_frame", state.alias("state")
    )


def track_history(detections: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """The newest boxes and confidences of each track, oldest first; the rank limit applies before the shuffle."""
    w = Window.partitionBy(*TRACK).orderBy(F.desc("ts"), F.desc("detection_id"))
    kept = detections.select(*TRACK, "ts", "detection_id", "bbox", "confidence").withColumn("rn", F.row_number().over(w))
    newest = kept.where(F.col("rn") <= cfg.history)
    items = F.sort_array(F.collect_list(F.struct("ts", "detection_id", "bbox", "confidence")))
    return newest.groupBy(*TRACK).agg(items.alias("history"))
