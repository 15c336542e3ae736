"""Hard negatives against brute force, and what the tree prunes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellgrid.llm import hard_negatives as hn
from tests.llm.cases import plain

SHAPE = "vec_id long, label int, embedding array<float>, id long, count int, cell int, positive long"


def clipped(x):
    return max(hn.LEAST, min(hn.MOST, x))


def brute(rows, step, k_pos=5, k_neg=10):
    usable = [(n, i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, lab, v) in enumerate(rows)
              if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, lab, q in usable:
        if i is None or i % step:
            continue
        scored = sorted((-clipped(sum(a * b for a, b in zip(q, v))), j is None, j or 0, j, other)
                        for m, j, other, v in usable if m != n and len(v) == len(q))
        for pos in [s for s in scored if s[4] == lab][:k_pos]:
            fits = [s for s in scored if s[4] != lab and 30 * -pos[0] <= 100 * -s[0] <= 90 * -pos[0]]
            out += [(i, pos[3], rank + 1, s[3], -pos[0], -s[0]) for rank, s in enumerate(fits[:k_neg])]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, lab, v, 1, 2, 3, 4) for i, lab, v in rows], SHAPE)


def clustered(seed, n, dim=8, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, int(rng.integers(0, 4)) if i % 3 else 0, (centres[i % clusters] + rng.normal(size=dim) * 0.2).tolist()) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:  # many cells, blocks and parts
        for name, value in (("CELL_ROWS", 20), ("BLOCK", 30), ("ANCHORS", 3), ("HELD", 10)):
            monkeypatch.setattr(hn, name, value)
    rows = clustered(1, 400)
    rows += [(1000 + i, 1, rows[0][2]) for i in range(90)] + [(2000 + i, 2, rows[5][2]) for i in range(90)]  # common vectors
    got = hn.mine_negatives(frame(spark, rows).repartition(3), F.col("vec_id") % 50 == 0)
    assert plain(got) == brute(rows, 50)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (50, 1, [0.5, 1.25]), (50, 1, [0.5, 1.25]), (50, 2, [0.5, 1.25]), (1, None, [1.0, 1.0]), (2, 1, None),
        (3, 2, [None, 1.0]), (4, 2, [nan, 1.0]), (5, 2, [inf, 1.0]), (6, 2, [0.3, 0.9]), (6, 2, [0.3, 0.9]), (None, 2, [0.4, 0.9]),
        (None, 1, [0.5, 1.0]), (7, 3, [1.0]), (100, 3, [2.0]), (8, 4, [1.0]), (9, 5, []), (150, 5, []), (10, 6, []),
        (11, 2, [-0.5, 0.1]), (200, 2, [-1.0, -1.0]), (12, 1, [-0.6, -0.5]), (13, 2, [0.2, 0.4]), (14, 3, [0.0, 0.0]),
        (250, 7, [1e18, 1.0]), (15, 7, [1e18, 2.0]), (16, 8, [5e17, 0.0]), (300, 9, [3.0, 4.0]),
    ]
    got = hn.mine_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert plain(got) == brute(rows, 50)


def test_few_or_no_rows(spark):
    for rows in ([], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])], [(1, 1, [1.0]), (2, 2, [1.0])]):
        assert hn.mine_negatives(frame(spark, rows), F.col("vec_id") % 50 == 0).count() == 0


def walk(tree, node, seen):
    if not isinstance(node, tuple):
        seen.append(node)
        return node
    table, children = node
    parts = [walk(tree, child, seen) for child in children]
    for j, part in enumerate(parts):
        gaps = hn.distances(tree.points[part], table.splits)
        assert (gaps.argmin(axis=1) == j).all()
        assert (gaps.T >= table.least[:, j][:, None] - 1e-9).all() and (gaps.T <= table.most[:, j][:, None] + 1e-9).all()
    return np.concatenate(parts)


def test_tree_keeps_its_ranges_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    points = np.floor(256 * (centres[np.arange(3000) % 30] + rng.normal(size=(3000, 16)) * 0.02))
    tree = hn.Tree(points)
    leaves = []
    assert sorted(walk(tree, tree.root, leaves)) == list(range(3000)) and len(leaves) > 60
    asked, scored = 20, []
    windows = hn.Windows(np.arange(asked), np.full(asked, hn.LEAST), np.full(asked, hn.MOST), 5)
    real = windows.offer
    windows.offer = lambda w, members, *rest: (scored.append(len(w) * len(members)), real(w, members, *rest))
    found = hn.search(tree, points[:asked], windows, np.ones((asked, 3000), bool), np.arange(3000))
    for w in range(asked):
        scores = points @ points[w]
        want = sorted((-int(s), i) for i, s in enumerate(scores))[:5]
        assert [(-int(s), int(p)) for v, p, s in zip(*found) if v == w] == want
    assert sum(scored) < 0.3 * asked * 3000  # most leaves fall out on clustered vectors
