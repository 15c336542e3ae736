"""Hard-negative mining with multiway hyperplane trees (GNAT).

Components become floor(256 * x); a score is the whole-number inner product with the anchor. An anchor's positives are its
best rows of the same label; the negatives of an (anchor, positive) pair are the best rows of other labels whose score
lies in a window below the positive's score.

1. Split points. A sample of at most ``CELLS`` vectors splits all points into the cells of the nearest split point. For
   every split point and every cell the least and the greatest distance are kept, and for every cell the range of norms.
   Cells are dealt into blocks of about ``BLOCK`` points.
2. A window of scores is an annulus of distances: d^2 = |q|^2 + |x|^2 - 2 score, with the norms of a cell. A cell takes no
   part if, for some split point, its range of distances cannot meet the annulus around the anchor.
3. A task gets one block and the windows that reach it, and builds a tree over the block in the same way: split points far
   from one another, a table of distance ranges from each to its siblings' subtrees, exact scores in the leaves. As better
   rows are found the lower end of a window rises, and more siblings fall out.
4. Round one searches each anchor's own cell, which gives a first k-th score; round two all other cells that are left.

Defined results: rows with a null label or a null vector, or with a null or non-finite component take no part; vectors of
another length than the anchor's are no candidates; ties go to the smaller id, null last; an anchor's own row is left out
once, further rows that repeat it are candidates; repeated anchor rows give repeated results, and repeated rows stand for
several positives or negatives. Scores are exact; one outside the 64-bit range counts as the nearest value in it. Fewer
candidates give fewer rows, a positive with a negative score none. Columns beyond id, label and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.llm.topk import inner
from dwellgrid.session import broadcast_if_small, cut_lineage

POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
SCALE = 256
CELLS = 256
CELL_ROWS = 4096  # points per split point, as long as there are fewer than CELLS
BLOCK = 8192
ANCHORS = 1024  # anchors of one task
LABEL_BUCKETS = 16
DEGREE = 12
LEAF = 48
LEAST, MOST = -(1 << 63), (1 << 63) - 1
HELD = 1 << 20  # candidates a task holds before it trims them


# -- geometry ---------------------------------------------------------------------------------------------------------


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to the few rows of b."""
    return np.stack([np.sqrt(((a - row) ** 2).sum(axis=1)) for row in b], axis=1)


def whole_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit numbers, those outside as the nearest value."""
    found = inner(a, b)
    if found.dtype == object:
        found = np.array([[max(LEAST, min(MOST, x)) for x in row] for row in found], dtype=object).reshape(found.shape)
    return found.astype(np.int64)


class Siblings:
    """Split points, distance ranges from each to every sibling's subtree, and the norms within each subtree."""

    def __init__(self, splits: np.ndarray, least: np.ndarray, most: np.ndarray, norms: np.ndarray):
        self.splits, self.least, self.most, self.norms = splits, least, most, norms

    def reachable(self, gaps: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which subtrees may hold scores in [low, high], per window.

        ``gaps`` are the anchors' distances to the split points and ``size`` their norms, one row per window."""
        with np.errstate(invalid="ignore", over="ignore"):
            slack = 1e-6 * (1 + size[:, None] + self.norms[None, :, 1])
            square = size[:, None] ** 2
            outer = square + self.norms[None, :, 1] ** 2 - 2.0 * low[:, None]
            inner_edge = square + self.norms[None, :, 0] ** 2 - 2.0 * high[:, None]
            far = np.where(low[:, None] == LEAST, np.inf, np.sqrt(np.maximum(outer, 0)) + slack)
            near = np.where(high[:, None] == MOST, 0, np.sqrt(np.maximum(inner_edge, 0)) - slack)
            out = outer < -slack * (1 + size[:, None] + self.norms[None, :, 1])
            out &= low[:, None] != LEAST
            for at in range(len(self.splits)):
                gap = gaps[:, at][:, None]
                out |= np.maximum(self.least[at] - gap, gap - self.most[at]) > far
                out |= gap + self.most[at] < near
        return ~out


class Tree:
    """A GNAT over the points of one block: nodes are (Siblings, children) or the members of a leaf."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.norms = np.sqrt((points**2).sum(axis=1))
        self.root = self._node(np.arange(len(points)))

    def _splits(self, members: np.ndarray) -> np.ndarray:
        """Far-apart members: each next one has the greatest distance to those before, among an even sample."""
        sample = members[np.linspace(0, len(members) - 1, min(len(members), 4 * DEGREE)).astype(int)]
        chosen = [0]
        gap = distances(self.points[sample], self.points[sample[:1]])[:, 0]
        while len(chosen) < DEGREE and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(self.points[sample], self.points[sample[chosen[-1:]]])[:, 0])
        return sample[chosen]

    def _node(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members
        splits = self._splits(members)
        if len(splits) == 1:  # the sample is one point: cut off all that equal it
            equal = (self.points[members] == self.points[splits[0]]).all(axis=1)
            if equal.all():
                return members
            splits = np.append(splits, members[~equal][:1])
        gaps = distances(self.points[members], self.points[splits])
        nearest = gaps.argmin(axis=1)
        parts = [np.flatnonzero(nearest == j) for j in range(len(splits))]
        table = Siblings(
            self.points[splits],
            np.array([[gaps[p, i].min() for p in parts] for i in range(len(splits))]),
            np.array([[gaps[p, i].max() for p in parts] for i in range(len(splits))]),
            np.array([[self.norms[members[p]].min(), self.norms[members[p]].max()] for p in parts]),
        )
        return table, [self._node(members[p]) for p in parts]


class Windows:
    """Score windows of some anchors and the best rows found for each; the lower ends rise to the k-th score."""

    def __init__(self, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.owner, self.low, self.high, self.k = owner, low.copy(), high, k
        self.top = np.full((len(owner), k), LEAST, np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, windows: np.ndarray, members: np.ndarray, scores: np.ndarray, allowed: np.ndarray, order: np.ndarray) -> None:
        """Scores (window, member) that may count; ``order`` ranks all points by id."""
        fits = allowed & (scores >= self.low[windows][:, None]) & (scores <= self.high[windows][:, None])
        rows, columns = np.nonzero(fits)
        if not len(rows):
            return
        touched = np.unique(rows)
        best = np.where(fits[touched], scores[touched], LEAST)
        merged = np.concatenate((self.top[windows[touched]], best), axis=1)
        self.top[windows[touched]] = np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k:]
        self.low[windows[touched]] = np.maximum(self.low[windows[touched]], self.top[windows[touched]].min(axis=1))
        self.found.append((windows[rows], members[columns], scores[rows, columns]))
        self.held += len(rows)
        if self.held > HELD:
            self.trim(order)

    def trim(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, point, score) of the k best points of each window, smaller ids first on ties."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        window, point, score = (np.concatenate(part) for part in zip(*self.found))
        inside = score >= self.low[window]
        window, point, score = window[inside], point[inside], score[inside]
        place = np.lexsort((order[point], -score.astype(object) if (score == LEAST).any() else -score, window))
        window, point, score = window[place], point[place], score[place]
        first = np.searchsorted(window, window)
        best = np.arange(len(window)) - first < self.k
        self.found = [(window[best], point[best], score[best])]
        self.held = int(best.sum())
        return self.found[0]


def search(
    tree: Tree, anchors: np.ndarray, windows: Windows, allowed: np.ndarray, order: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, point, score): for each window its best allowed points; ``allowed`` is (anchor, point)."""
    size = np.sqrt((anchors**2).sum(axis=1))
    stack = [(tree.root, np.arange(len(windows.owner)))]
    while stack:
        node, active = stack.pop()
        owners, row = np.unique(windows.owner[active], return_inverse=True)
        if isinstance(node, tuple):
            table, children = node
            gaps = distances(anchors[owners], table.splits)[row]
            open_ = table.reachable(gaps, size[windows.owner[active]], windows.low[active], windows.high[active])
            for at in np.argsort(-gaps.mean(axis=0), kind="stable").tolist():  # the nearest is searched first
                if open_[:, at].any():
                    stack.append((children[at], active[open_[:, at]]))
        else:
            scores = whole_scores(anchors[owners], tree.points[node])
            windows.offer(active, node, scores[row], allowed[np.ix_(owners, node)][row], order)
    return windows.trim(order)


# -- Spark steps ------------------------------------------------------------------------------------------------------

POINT = "id long, label long, dim int, vector binary, count int"


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim)


def quantised_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, dim, vector as packed doubles, count) of all rows that take part."""
    vector = F.col(vector_col)
    usable = vector.isNotNull() & F.col(label_col).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    parts = rows.where(usable).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        vector.cast("array<double>").alias("v"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.floor(SCALE * np.asarray(v.values, float)) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(v) for v in whole], pa.int32()),
                 pa.array([(v + 0.0).tobytes() for v in whole], pa.binary())], ["id", "label", "dim", "vector"]
            )

    packed = parts.mapInArrow(run, "id long, label long, dim int, vector binary")
    return packed.groupBy("id", "label", "dim", "vector").agg(F.count("*").cast("int").alias("count"))


def split_points(points: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Split points per vector length: the first points by a hash of the id, at most ``CELLS`` in all."""
    cells = max(1, min(CELLS, math.ceil(total / CELL_ROWS)))
    first = points.orderBy(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), "dim", "vector").limit(cells)
    found: dict[int, set] = {}
    for row in first.select("dim", "vector").collect():
        found.setdefault(row.dim, set()).add(bytes(row.vector))
    return {dim: matrix(sorted(vectors), dim) for dim, vectors in found.items() if dim}


def with_cells(points: DataFrame, splits: dict[int, np.ndarray]) -> DataFrame:
    """Adds the cell (nearest split point of the same length, 0 without any) and the label's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, packed = batch.column("dim").to_numpy(), batch.column("vector").to_pylist()
            cells = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in splits:
                    rows = np.flatnonzero(dims == dim)
                    cells[rows] = distances(matrix([packed[i] for i in rows], dim), splits[dim]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    bucket = F.pmod(F.xxhash64("label"), F.lit(LABEL_BUCKETS)).cast("int")
    return points.mapInArrow(run, f"{POINT}, cell int").withColumn("bucket", bucket)


def in_blocks(points: DataFrame) -> DataFrame:
    """Adds a block number within (dim, cell, bucket)."""
    key = ["dim", "cell", "bucket"]
    sizes = points.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int")
    return points.join(sizes, key).withColumn("block", block).drop("blocks")


def sibling_tables(points: DataFrame, splits: dict[int, np.ndarray]) -> dict[int, Siblings]:
    """Distance ranges from every split point to every cell; at most ``CELLS`` x (``CELLS`` + 1) numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {d: (np.full((len(s), len(s) + 1), np.inf), np.full((len(s), len(s) + 1), -np.inf)) for d, s in splits.items()}
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            packed = batch.column("vector").to_pylist()
            for dim in np.unique(dims).tolist():
                if dim not in splits:
                    continue
                rows = np.flatnonzero(dims == dim)
                there = matrix([packed[i] for i in rows], dim)
                values = np.column_stack((distances(there, splits[dim]), np.sqrt((there**2).sum(axis=1))))
                np.minimum.at(held[dim][0], cells[rows], values)
                np.maximum.at(held[dim][1], cells[rows], values)
        for dim, (least, most) in held.items():
            cell, split = np.nonzero(least <= most)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cell), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(split, pa.int32()),
                 pa.array(least[cell, split]), pa.array(most[cell, split])], ["dim", "cell", "split", "least", "most"]
            )

    parts = points.select("dim", "cell", "vector").mapInArrow(run, "dim int, cell int, split int, least double, most double")
    ranges = parts.groupBy("dim", "cell", "split").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    tables = {}
    shape = {d: (len(s), len(s) + 1) for d, s in splits.items()}
    least, most = ({d: np.full(n, fill) for d, n in shape.items()} for fill in (np.inf, -np.inf))
    for row in ranges.collect():
        least[row.dim][row.cell, row.split], most[row.dim][row.cell, row.split] = row.least, row.most
    for dim, vectors in splits.items():
        norms = np.column_stack((least[dim][:, -1], most[dim][:, -1]))
        tables[dim] = Siblings(vectors, least[dim][:, :-1].T, most[dim][:, :-1].T, norms)
    return tables


ASKED = "dim int, a_id long, a_label long, a_vector binary, positive long, low long, high long"


def window_of(positive: int | None, percents: tuple[int, int]) -> tuple[int, int]:
    """Least and greatest score that a negative may have; all scores without a positive."""
    if positive is None:
        return LEAST, MOST
    return -((-percents[0] * positive) // 100), (percents[1] * positive) // 100


def asked_cells(asked: DataFrame, tables: dict[int, Siblings], home: bool, percents: tuple[int, int]) -> DataFrame:
    """Windows (dim, a_id, a_label, a_vector, positive, floor) with each cell to search: their own, or the others left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, packed = batch.column("dim").to_numpy(), batch.column("a_vector").to_pylist()
            positives, floors = batch.column("positive").to_pylist(), batch.column("floor").to_pylist()
            edges = [window_of(p, percents) for p in positives]
            low = np.array([max(e[0], LEAST if f is None else f) for e, f in zip(edges, floors)], np.int64)
            high = np.array([e[1] for e in edges], np.int64)
            rows, cells = [], []
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero((dims == dim) & (low <= high))
                if dim not in tables:
                    rows.append(mine if home else mine[:0])
                    cells.append(np.zeros(len(rows[-1]), np.int64))
                    continue
                there = matrix([packed[i] for i in mine], dim)
                gaps = distances(there, tables[dim].splits)
                own = np.arange(gaps.shape[1]) == gaps.argmin(axis=1)[:, None]
                if not home:
                    own = ~own & tables[dim].reachable(gaps, np.sqrt((there**2).sum(axis=1)), low[mine], high[mine])
                at, cell = np.nonzero(own)
                rows.append(mine[at])
                cells.append(cell)
            rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
            cells = np.concatenate(cells) if cells else np.empty(0, np.int64)
            kept = batch.select(["dim", "a_id", "a_label", "a_vector", "positive"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(low[rows]), pa.array(high[rows]), pa.array(cells, pa.int32())],
                [*kept.schema.names, "low", "high", "cell"],
            )

    return asked.select("dim", "a_id", "a_label", "a_vector", "positive", "floor").mapInArrow(run, f"{ASKED}, cell int")


FOUND = "a_id long, a_label long, a_vector binary, positive long, id long, score long, count int"


def search_blocks(asked: DataFrame, points: DataFrame, k: int, same_label: bool, parts: int) -> DataFrame:
    """Best rows of each window among the points of the cells it is paired with, up to k distinct points per block."""
    blocks = broadcast_if_small(points.select("dim", "cell", "bucket", "block").distinct())
    asked = asked.withColumn("part", F.pmod(F.xxhash64("a_id", "a_vector"), F.lit(parts)).cast("int"))
    on = ["dim", "cell"]
    if same_label:
        asked = asked.withColumn("bucket", F.pmod(F.xxhash64("a_label"), F.lit(LABEL_BUCKETS)).cast("int"))
        on = [*on, "bucket"]
    jobs = asked.join(blocks, on)
    key = ["dim", "cell", "bucket", "block", "part"]
    wanted = jobs.select(key).distinct()
    right = points.join(wanted, key[:4]).select("id", "label", "vector", "count", *(F.col(c).alias(f"p_{c}") for c in key))

    def run(ask: pa.Table, there: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in FOUND.split(", ")]
        if ask.num_rows and there.num_rows:
            dim = ask.column("dim")[0].as_py()
            ids = there.column("id").to_pylist()
            order = np.empty(len(ids), np.int64)
            order[sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))] = np.arange(len(ids))
            packed, counts = there.column("vector").to_pylist(), there.column("count").to_numpy()
            labels = there.column("label").to_numpy()
            askers = list(zip(*(ask.column(c).to_pylist() for c in ("a_id", "a_label", "a_vector"))))
            numbers = {a: n for n, a in enumerate(dict.fromkeys(askers))}
            owner = np.array([numbers[a] for a in askers])
            same = np.array([a[1] for a in numbers])[:, None] == labels[None, :]
            counted = np.broadcast_to(counts, same.shape).copy()
            places: dict[tuple, int] = {(i, x, v): n for n, (i, x, v) in enumerate(zip(ids, labels.tolist(), packed))}
            for number, asker in enumerate(numbers):
                if asker in places:
                    counted[number, places[asker]] -= 1
            allowed = (same if same_label else ~same) & (counted > 0)
            windows = Windows(owner, ask.column("low").to_numpy(), ask.column("high").to_numpy(), k)
            anchors = matrix([a[2] for a in numbers], dim)
            window, point, score = search(Tree(matrix(packed, dim)), anchors, windows, allowed, order)
            taken = ask.select(["a_id", "a_label", "a_vector", "positive"]).take(pa.array(window))
            out = [*(taken.column(c).to_pylist() for c in taken.column_names), [ids[p] for p in point.tolist()],
                   score.tolist(), counted[owner[window], point].tolist()]
        names = [c.split() for c in FOUND.split(", ")]
        kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
        return pa.table({name: pa.array(values, kinds[kind]) for (name, kind), values in zip(names, out)})

    return jobs.groupBy(key).cogroup(right.groupBy([f"p_{c}" for c in key])).applyInArrow(run, FOUND)


ANCHOR = ["a_id", "a_label", "a_vector"]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each window, ranked; counts become rows."""
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)))))
    order = Window.partitionBy(*ANCHOR, "positive").orderBy(F.desc("score"), F.asc_nulls_last("id"), "copy")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(
    asked: DataFrame, points: DataFrame, tables: dict[int, Siblings], k: int, same_label: bool, parts: int,
    percents: tuple[int, int],
) -> DataFrame:
    """The k best rows of each window: first its own cell, then the cells that the first k-th score leaves."""
    floorless = asked.withColumn("floor", F.lit(None).cast("long"))
    home = asked_cells(floorless, tables, True, percents)
    first = cut_lineage(ranked(search_blocks(home, points, k, same_label, parts), k))
    floors = first.where(F.col("rank") == k).select(
        *(F.col(c).alias(f"f_{c}") for c in [*ANCHOR, "positive"]), F.col("score").alias("floor")
    )
    window = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in [*ANCHOR, "positive"]]
    others = asked_cells(asked.join(floors, window, "left"), tables, False, percents)
    second = search_blocks(others, points, k, same_label, parts)
    columns = [c.split()[0] for c in FOUND.split(", ")]
    known = first.withColumn("count", F.lit(1)).select(columns)
    return cut_lineage(ranked(known.unionByName(second.select(columns)), k))


def mine_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, percents: tuple[int, int] = (LOW_PERCENT, HIGH_PERCENT),
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` chooses the anchors; negatives satisfy percents[0] * positive_score <= 100 * negative_score <=
    percents[1] * positive_score.
    """
    points = cut_lineage(quantised_rows(rows, id_col, label_col, vector_col))
    total = points.count()
    splits = split_points(points, total)
    points = cut_lineage(in_blocks(with_cells(points, splits)))
    tables = sibling_tables(points, splits)
    chosen = cut_lineage(quantised_rows(rows.where(is_anchor), id_col, label_col, vector_col))
    parts = max(1, math.ceil(chosen.count() / ANCHORS))
    anchors = chosen.select("dim", F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("vector").alias("a_vector"))
    asked = anchors.withColumn("positive", F.lit(None).cast("long"))
    near = best_rows(asked, points, tables, positives, True, parts, percents)
    pairs = near.select(
        *(F.col(c).alias(f"n_{c}") for c in ANCHOR), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    same_anchor = [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in ANCHOR]
    windows = cut_lineage(
        anchors.join(pairs, same_anchor).select("dim", *ANCHOR, F.col("positive_score").alias("positive")).distinct()
    )
    hard = best_rows(windows, points, tables, negatives, False, parts, percents)
    times = chosen.select(*(F.col(c).alias(f"t_{a}") for c, a in zip(("id", "label", "vector"), ANCHOR)), F.col("count").alias("times"))
    matched = same_anchor + [F.col("positive") == F.col("positive_score")]
    again = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in ANCHOR]
    return (
        hard.join(pairs, matched).join(times, again)
        .withColumn("again", F.explode(F.sequence(F.lit(1), "times")))
        .select(F.col("a_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
                F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
