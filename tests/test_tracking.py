"""Live tracks against a tracker that walks every frame, and the numbers of frames after which a track is gone."""

import numpy as np
import pytest

from dwellgrid.operators import tracking
from dwellgrid.config import DetectionConfig

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
SHAPE = f"store_id string, camera_id string, frame_idx long, detection_id string, bbox {BOX}, confidence double"
HERE = (0.0, 0.0, 100.0, 200.0)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)


def walk(rows):
    """Every frame of a camera in turn, also those without detections."""
    cameras, out, ends = {}, {}, {}
    for r in rows:
        cameras.setdefault(r[:2], []).append(r)
    for camera, found in cameras.items():
        tracks, number = [], 0
        for frame in range(min(r[2] for r in found), max(r[2] for r in found) + 1):
            now = [r for r in found if r[2] == frame]
            high = sorted((r for r in now if r[5] is not None and r[5] >= 0.6), key=lambda r: (-r[5], r[3]))
            low = sorted((r for r in now if r[5] is None or r[5] < 0.6), key=lambda r: r[3])
            for t in tracks:
                t["idle"] += 1
            taken = []
            for r in high + low:
                best, best_iou = None, 0.0
                for t in tracks:
                    if t["id"] in taken or t["state"] == "DELETED" or (r in low and t["state"] != "LOST") or r[4] is None:
                        continue
                    if overlap(r[4], t["box"]) > best_iou:
                        best, best_iou = t, overlap(r[4], t["box"])
                if best is not None and best_iou >= 0.3:
                    best.update(idle=0, hits=best["hits"] + 1, box=r[4])
                    if best["hits"] >= 5:
                        best["state"] = "CONFIRMED"
                    taken.append(best["id"])
                    out[r[3]] = (best["id"], "matched", round(best_iou, 9))
                elif r in high and r[4] is not None:
                    number += 1
                    tracks.append({"id": number, "box": r[4], "state": "TENTATIVE", "hits": 1, "idle": 0})
                    out[r[3]] = (number, "opened", None)
                else:
                    out[r[3]] = (None, "discarded", None)
            for t in tracks:
                if t["id"] not in taken:
                    if t["idle"] > 90:
                        t["state"] = "DELETED"
                    elif t["state"] == "CONFIRMED":
                        t["state"] = "LOST"
        ends.update({(*camera, t["id"]): (t["state"], t["hits"]) for t in tracks})
    return out, ends


def people(seed, frames=700, crowd=6):
    """A 15 fps feed: people stand, step aside, vanish for up to 120 frames, and are seen with high or low confidence."""
    rng = np.random.default_rng(seed)
    rows, away = [], {}
    for frame in range(frames):
        for who in range(crowd):
            if away.get(who, 0) > frame or rng.random() < 0.4:
                continue
            if rng.random() < 0.05:
                away[who] = frame + int(rng.integers(1, 125))
            x = who * 55.0 + float(rng.integers(0, 40))
            box = (x, 0.0, x + 100.0, 200.0) if rng.random() > 0.01 else None
            sure = None if rng.random() < 0.01 else float(rng.choice([0.4, 0.55, 0.6, 0.7, 0.9]))
            rows.append(("S", f"C{who % 2}", frame, f"{frame:04d}-{who}", box, sure))
    return rows


def got(df):
    return {r.detection_id: (r.track_id, r.how, None if r.iou is None else round(r.iou, 9)) for r in df.collect()}


@pytest.mark.parametrize("chunk_rows", [1, 100, 100_000])
def test_chunks_give_the_walk(spark, chunk_rows):
    rows = people(1)
    want, ends = walk(rows)
    assert {w[1] for w in want.values()} == {"matched", "opened", "discarded"} and {e[0] for e in ends.values()} >= {"DELETED", "TENTATIVE"}
    frames = spark.createDataFrame(rows, SHAPE).repartition(3)
    tracked = tracking.track_detections(frames, chunk_rows=chunk_rows)
    assert got(tracked) == want
    table = {(r.store_id, r.camera_id, r.track_id): (r.state, r.hits) for r in tracking.track_table(tracked, frames).collect()}
    assert table == {k: (s, h) for k, (s, h) in ends.items()}


@pytest.mark.parametrize("gap, same", [(1, True), (90, True), (91, True), (92, False)])
def test_how_long_a_track_is_kept(spark, gap, same):
    rows = [("S", "C", 10, "a", HERE, 0.9), ("S", "C", 10 + gap, "b", HERE, 0.9)]
    assert (got(tracking.track_detections(spark.createDataFrame(rows, SHAPE)))["b"][0] == 1) is same
    assert (walk(rows)[0]["b"][0] == 1) is same


def test_low_confidence_takes_lost_tracks_only(spark):
    sure = [("S", "C", f, f"h{f}", HERE, 0.9) for f in range(5)]
    for rows, how in (
        (sure[:4] + [("S", "C", 6, "low", HERE, 0.4)], "discarded"),  # four hits: never confirmed, so never lost
        (sure + [("S", "C", 5, "low", HERE, 0.4)], "discarded"),  # confirmed in the frame before, not yet lost
        (sure + [("S", "C", 6, "low", HERE, 0.4)], "matched"),
        (sure + [("S", "C", 4 + 91, "low", HERE, None)], "matched"),
        (sure + [("S", "C", 4 + 92, "low", HERE, 0.4)], "discarded"),
    ):
        assert got(tracking.track_detections(spark.createDataFrame(rows, SHAPE)))["low"][1] == how == walk(rows)[0]["low"][1]


def test_odd_detections(spark):
    rows = [(None, None, 1, "a", HERE, 0.9), (None, None, 2, "b", HERE, 0.8), ("S", "C", None, "c", HERE, 0.9),
            ("S", "C", 1, "d", None, 0.9), ("S", "C", 1, "e", (0.0, None, 1.0, 1.0), 0.9), ("S", "C", 1, "f", (5.0, 5.0, 5.0, 5.0), 0.9),
            ("S", "C", 2, "g", (5.0, 5.0, 5.0, 5.0), 0.9), ("S", "C", 3, "h", HERE, 0.9), ("S", "C", 3, "i", HERE, 0.7)]
    found = got(tracking.track_detections(spark.createDataFrame(rows, SHAPE)))
    assert found["b"] == (1, "matched", 1.0) and "c" not in found and found["d"][1] == found["e"][1] == "discarded"
    assert found["g"][1] == "opened" and found["i"] == (3, "matched", 1.0)  # the track that the same frame has just opened
    assert tracking.track_detections(spark.createDataFrame([], SHAPE)).count() == 0
    assert DetectionConfig().max_lost_frames == 90


@pytest.mark.parametrize("piece", [1, 2, 5, 100])
def test_frames_in_pieces_give_the_walk(piece):
    """All detections of a frame are compared at once; a frame may be cut between two batches."""
    rows = [r for r in people(3, frames=400) if r[1] == "C0"]
    want, _ = walk(rows)
    tracks, found, numbers = tracking.LiveTracks(DetectionConfig(), []), {}, {}
    for frame in sorted({r[2] for r in rows}):
        turns = sorted((r for r in rows if r[2] == frame), key=lambda r: (-r[5] if (r[5] or 0) >= 0.6 else float("inf"), r[3]))
        for begin in range(0, len(turns), piece):
            tracks.start_frame(frame)
            now = [dict(frame_idx=frame, detection_id=r[3], sure=(r[5] or 0) >= 0.6, box=r[4]) for r in turns[begin:begin + piece]]
            for row, (root, how, iou) in zip(now, tracks.place_all(frame, now)):
                track = None if root is None else numbers.setdefault(root, len(numbers) + 1)
                found[row["detection_id"]] = (track, how, None if iou is None else round(iou, 9))
    assert found == want
