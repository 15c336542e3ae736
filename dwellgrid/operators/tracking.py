"""Tracks of a camera: detections meet the live tracks, frame after frame.

In every frame detections of high confidence choose first, the surest first, each the live track with the greatest overlap
(``iou_threshold`` or more) that no other detection of the frame has taken; without one they open a track, which later
detections of the same frame may still take. Detections of low confidence follow; they may take lost tracks only, and are
discarded otherwise. A track is confirmed by ``min_hits`` hits, lost in a frame without a hit, and deleted after more than
``max_lost_frames`` frames without one, at the end of a frame: a detection ``max_lost_frames`` + 1 frames after the last hit still
finds it. Frames without detections count, so ``frame_idx`` numbers the frames that the camera delivered.

The fold runs per camera in chunks that are reconciled at their borders (see ``speculation``).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count, groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.config import DetectionConfig
from dwellgrid.functions.scoring import exact_avg
from dwellgrid.operators.ordered import OrderedRows
from dwellgrid.operators.speculation import fold_in_rounds, in_chunks

CAMERA = ["store_id", "camera_id"]
CHUNK_ROWS = 200_000
MEMORIES = 16  # a chunk lasts at least this many times as long as a track is remembered
_NO_BOX = [np.nan] * 4
TRACK = "struct<root:string,hits:long,last:long,matched:long,box:array<double>>"
TRACKED = "frame_idx long, turn long, detection_id string, root string, how string, iou double"


class LiveTracks:
    """The tracks of one camera that are not deleted, in order of creation."""

    def __init__(self, cfg: DetectionConfig, states: list[dict]):
        self.cfg = cfg
        self.roots = [s["root"] for s in states]
        self.hits, self.last, self.matched = (np.array([s[f] for s in states], np.int64) for f in ("hits", "last", "matched"))
        self.boxes = np.array([s["box"] for s in states], float).reshape(-1, 4)

    def start_frame(self, frame: int) -> None:
        """Forgets what an earlier frame deleted."""
        live = frame - 1 - self.last <= self.cfg.max_lost_frames
        if not live.all():
            self.roots = [r for r, kept in zip(self.roots, live.tolist()) if kept]
            self.hits, self.last, self.matched, self.boxes = (x[live] for x in (self.hits, self.last, self.matched, self.boxes))

    def place_all(self, frame: int, rows: list[dict]) -> list[tuple[str | None, str, float | None]]:
        """(track, how, overlap) of the next detections of one frame, which may come in several pieces. A track has one
        detection in a frame, so no box that is still free moves within it and all overlaps are known at its start; behind
        the tracks come the detections, each of which may open one."""
        n, size = len(self.roots), len(rows)
        boxes = np.array([_NO_BOX if row["box"] is None else row["box"] for row in rows], float).reshape(-1, 4)
        iou = np.zeros((size, n + size))
        iou[:, :n] = _overlaps(boxes, self.boxes)
        iou[:, :n][:, self.matched == frame] = 0
        unsure = np.array([not row["sure"] for row in rows])
        lost = (self.hits >= self.cfg.min_hits) & (frame - 1 > self.last)
        iou[:, :n] *= lost | ~unsure[:, None]
        own = _overlaps(boxes, boxes) if size > 1 else None
        out, opened, taken, again = [], [], [], []  # places of detections that open tracks, of tracks and their detections
        for i, row in enumerate(rows):
            width = n + len(opened)
            at = int(iou[i, :width].argmax()) if width else 0  # the first of equals is the oldest
            reached = float(iou[i, at]) if width else 0.0
            if row["box"] is not None and reached > 0 and reached >= self.cfg.iou_threshold:
                iou[i:, at] = 0
                taken.append(at)
                again.append(i)
                out.append((self.roots[at], "matched", reached))
            elif not row["sure"] or row["box"] is None:
                out.append((None, "discarded", None))
            else:
                if own is not None:  # the others may take it, if they are sure: it is not lost
                    iou[:, width] = np.where(unsure, 0.0, own[:, i])
                opened.append(i)
                self.roots.append(row["detection_id"])
                out.append((row["detection_id"], "opened", None))
        if opened:
            more = len(opened)
            self.hits, self.last, self.matched = (
                np.concatenate((x, np.full(more, v))) for x, v in ((self.hits, 1), (self.last, frame), (self.matched, -1)))
            self.boxes = np.concatenate((self.boxes, boxes[opened]))
        if taken:
            self.hits[taken] += 1
            self.last[taken] = self.matched[taken] = frame
            self.boxes[taken] = boxes[again]
        return out

    def states(self) -> list[dict]:
        columns = (self.roots, self.hits.tolist(), self.last.tolist(), self.matched.tolist(), self.boxes.tolist())
        return [dict(zip(("root", "hits", "last", "matched", "box"), values)) for values in zip(*columns)]


def _overlaps(boxes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Overlap of each box with each other one; a missing box overlaps with none."""
    x1, y1, x2, y2 = (boxes[:, i, None] for i in range(4))
    u1, v1, u2, v2 = others.T
    inter = np.maximum(0, np.minimum(x2, u2) - np.maximum(x1, u1)) * np.maximum(0, np.minimum(y2, v2) - np.maximum(y1, v1))
    union = (x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - inter
    return np.where((inter > 0) & (union > 0), inter / np.where(union > 0, union, 1), 0.0)


def track_detections(detections: DataFrame, cfg: DetectionConfig = DetectionConfig(), chunk_rows: int | None = None) -> DataFrame:
    """(store_id, camera_id, frame_idx, detection_id, track_id, how, iou): the track of each detection.

    ``how`` is matched, opened or discarded (without a track). Track numbers run from 1 per camera in order of creation.
    Detections without a frame take no part, those without a box or with a corner missing are discarded; a missing
    confidence is low. Equal confidences and all low ones go by detection id.
    """
    corners = [F.col(f"bbox.{c}").cast("double") for c in ("x1", "y1", "x2", "y2")]
    whole = F.lit(True)
    for corner in corners:
        whole = whole & corner.isNotNull()
    sure = F.coalesce(F.col("confidence") >= cfg.high_confidence, F.lit(False))
    rows = detections.where(F.col("frame_idx").isNotNull()).select(
        *CAMERA, F.col("frame_idx").cast("long").alias("frame_idx"), "detection_id", sure.alias("sure"),
        F.when(sure, -F.col("confidence").cast("double")).otherwise(F.lit(float("inf"))).alias("turn_by"),
        F.when(whole, F.array(*corners)).alias("box"),
    )

    def fold(state: list[dict]) -> tuple[Callable[[list[dict]], list[tuple]], Callable[[], list[dict]]]:
        tracks, turns = LiveTracks(cfg, state), count()

        def place(rows: list[dict]) -> list[tuple]:
            out = []
            for frame, found in groupby(rows, key=lambda row: row["frame_idx"]):
                frame_rows = list(found)
                tracks.start_frame(frame)
                for row, placed in zip(frame_rows, tracks.place_all(frame, frame_rows)):
                    out.append((frame, next(turns), row["detection_id"], *placed))
            return out

        return place, tracks.states

    memory = cfg.max_lost_frames + 2
    placed = fold_in_rounds(
        in_chunks(rows, CAMERA, "frame_idx", memory if chunk_rows else MEMORIES * memory, chunk_rows or CHUNK_ROWS),
        CAMERA, ["frame_idx", "turn_by", "detection_id"], fold, TRACKED, TRACK, "frame_idx",
        lambda track, begin: begin - 1 - track["last"] <= cfg.max_lost_frames, many=True,
    )
    return _numbered(placed)


def _numbered(placed: DataFrame) -> DataFrame:
    """Track numbers in order of creation; a root is one detection, so the join is one to one on the roots' side."""
    opened = placed.where("how = 'opened'").select(*CAMERA, "frame_idx", "turn", F.col("detection_id").alias("first_id"))
    numbers = OrderedRows.of(opened, CAMERA, ["frame_idx", "turn", "first_id"]).row_number("track_id").result().select(
        *(F.col(c).alias(f"n_{c}") for c in CAMERA), "first_id", F.col("track_id").cast("long").alias("track_id")
    )
    same = F.col("root") == F.col("first_id")
    for c in CAMERA:
        same = same & F.col(c).eqNullSafe(F.col(f"n_{c}"))
    return placed.join(numbers, same, "left").select(*CAMERA, "frame_idx", "detection_id", "track_id", "how", "iou")


def track_table(tracked: DataFrame, detections: DataFrame, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """One row per track at the end of the camera's feed: frames, hits, mean confidence and state."""
    feed = detections.groupBy(*(F.col(c).alias(f"f_{c}") for c in CAMERA)).agg(F.max("frame_idx").alias("feed"))
    same = F.lit(True)
    for c in CAMERA:
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    seen = detections.select(F.col("detection_id").alias("d_id"), "confidence")
    per_track = tracked.where(F.col("track_id").isNotNull()).join(seen, F.col("detection_id") == F.col("d_id")).groupBy(
        *CAMERA, "track_id"
    ).agg(
        F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("hits"),
        exact_avg(F.col("confidence")).alias("avg_confidence"),
    )
    return per_track.join(feed, same).select(
        *CAMERA, "track_id", "first_frame", "last_frame", "hits", "avg_confidence", track_state(cfg).alias("state")
    )


def track_state(cfg: DetectionConfig) -> Column:
    """State after the last frame ``feed`` of a track with ``hits``, last hit in ``last_frame``."""
    idle, sure = F.col("feed") - F.col("last_frame"), F.col("hits") >= cfg.min_hits
    return (
        F.when(idle > cfg.max_lost_frames, "DELETED").when(sure & (idle > 0), "LOST").when(sure, "CONFIRMED").otherwise("TENTATIVE")
    )
