"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellgrid.llm import topk
from tests.llm.cases import plain

SHAPE = "vec_id long, embedding array<float>, label int, rank int, cell int"


def brute(rows, k=5, step=50):
    usable = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows)
              if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i is None or i % step:
            continue
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j is None, j or 0, j)
                        for m, j, v in usable if m != n and len(v) == len(q))
        out += [(i, rank + 1, s[3], -s[0]) for rank, s in enumerate(scored[:k])]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SHAPE)


@pytest.mark.parametrize("block", [16, 2048])
def test_clusters_ties_and_repeated_vectors(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 8))
    rows = [(i, (centres[i % 4] + rng.normal(size=8) * 0.05).astype(np.float32).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # one very common vector
    docs = frame(spark, rows)
    got = topk.top_k(docs, F.col("vec_id") % 50 == 0, block=block)
    assert plain(got) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [0.5, -0.25]), (50, [0.5, -0.25]), (50, [3.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]),
        (4, [inf, 1.0]), (5, [-inf, 0.0]), (6, [1.0]), (100, [2.0]), (7, []), (150, []), (None, [4.0, 4.0]), (8, [0.0, 0.0]),
        (9, [0.001, -0.001]), (10, [1.0, 2.0]), (10, [1.0, 2.0]), (200, [1e30, -1e30]), (11, [1e20, 1e20]), (12, [-1e30, 1e30]),
    ]
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and plain(got) == brute(rows)


def test_few_or_no_rows(spark):
    one = frame(spark, [(0, [1.0])])
    assert topk.top_k(one, F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(one.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(frame(spark, [(1, [1.0]), (2, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(5)
    points = np.floor(256 * np.concatenate([rng.normal(size=(300, 6)) * 0.01 + c for c in rng.normal(size=(5, 6)) * 3]))
    tree = topk.CoverTree(points)
    for members, centre, radius, children in zip(tree.members, tree.centres, tree.radii, tree.children):
        assert np.sqrt(((points[members] - centre) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if children:
            assert sorted(np.concatenate([tree.members[c] for c in children])) == sorted(members)
    assert len(tree.members) > 5
    ids = list(range(len(points)))
    found = topk.search(points[::50], ids[::50], [None] * 30, points, ids, [1] * len(ids), 3)
    for q, entries in zip(range(0, 1500, 50), found):
        scores = points @ points[q]
        want = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:3]
        assert [(e[0], e[2]) for e in entries[:3]] == want
