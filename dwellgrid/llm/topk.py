"""Exact top-k inner-product search with dual cover trees.

Components become floor(256 * x); the score is their inner product in whole numbers.

1. Points: rows that agree in id and vector are one point with a count. The first points by a hash of the id serve as
   pivots (``BLOCK`` times fewer than points, at most ``MAX_CELLS``); every point belongs to the cell of its nearest
   pivot, and cells are dealt into blocks of about ``BLOCK`` points. Queries are blocked alike.
2. A task gets one block of queries and one block of points, builds a cover tree over each and walks both together. A node
   holds its centre and covering radius; for a pair of nodes no score can exceed
   <q, p> + r_q |p| + r_p |q| + r_q r_p. The pair is pruned when this is below the worst k-th score of the query group.
3. Round one searches the cell nearest to each query block and gives every query a first k-th score. Round two searches
   all other cells that the same bound, taken over whole cells, does not prune. The best k of both rounds remain.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of another length than
the query's are no candidates; ties go to the smaller id, null last; a query's own row is left out once, further rows
that repeat it are candidates; repeated query rows give repeated results. Sums beyond 2^53 are computed in exact whole
numbers; a score outside the 64-bit range is returned as the nearest value in it. Fewer candidates give fewer ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.session import cut_lineage

K = 5
QUERY_STEP = 50
SCALE = 256
BLOCK = 2048
MAX_CELLS = 1024
LEAF = 64
MAX_CHILDREN = 32
EXACT = float(1 << 53)


# -- trees ------------------------------------------------------------------------------------------------------------


class CoverTree:
    """Nodes over points: centre, covering radius, members; children lie within half the level of their parent."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.norms: list[float] = []
        self._node(np.arange(len(points)))

    def _node(self, members: np.ndarray) -> int:
        centre = self.points[members[0]]
        far = np.sqrt(((self.points[members] - centre) ** 2).sum(axis=1))
        at = len(self.members)
        self.members.append(members)
        self.children.append([])
        self.centres.append(centre)
        self.radii.append(float(far.max()))
        self.norms.append(float(np.sqrt((centre**2).sum())))
        if len(members) > LEAF and self.radii[at] > 0:
            self.children[at] = [self._node(part) for part in self._split(members, far)]
        return at

    def _split(self, members: np.ndarray, far: np.ndarray) -> list[np.ndarray]:
        """Parts within half the level of a centre; what is left over after ``MAX_CHILDREN`` centres, in leaf bags."""
        reach = 2.0 ** (math.ceil(math.log2(far.max())) - 1)
        parts, bag = [], []
        left, near = members, far <= reach
        for _ in range(MAX_CHILDREN):
            (parts if near.sum() > LEAF // 8 else bag).append(left[near])
            left = left[~near]
            if not len(left):
                break
            near = np.sqrt(((self.points[left] - self.points[left[0]]) ** 2).sum(axis=1)) <= reach
        if len(parts) == 1 and len(parts[0]) == len(members):  # the centre alone covers all: cut by distance
            order = np.argsort(far, kind="stable")
            return [members[h] for h in np.array_split(order, 2)]
        rest = np.concatenate([*bag, left])
        return parts + [rest[i:i + LEAF] for i in range(0, len(rest), LEAF)]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, floors: list, k: int):
        self.k, self.floors = k, floors
        self.kept: list[list[tuple]] = [[] for _ in floors]
        self.worst = np.array([-np.inf if f is None else float(f) for f in floors])

    def offer(self, query: int, scores: list, ids: list, counts: list) -> None:
        found = self.kept[query]
        found += [(-s, i is None, i or 0, c) for s, i, c in zip(scores, ids, counts)]
        found.sort()
        room = 0
        for at, entry in enumerate(found):
            room += entry[3]
            if room >= self.k:
                del found[at + 1:]
                self.worst[query] = max(self.worst[query], float(-entry[0]))
                break


def search(
    queries: np.ndarray, query_ids: list, floors: list, points: np.ndarray, ids: list, counts: list, k: int
) -> list[list[tuple]]:
    """For each query its best entries (-score, id is null, id, count) among the points, none below its floor."""
    best = Best(floors, k)
    left, right = CoverTree(queries), CoverTree(points)
    own = {}
    for at, i in enumerate(ids):
        own.setdefault(i, []).append(at)

    def bound(q: int, p: int) -> float:
        most = float(left.centres[q] @ right.centres[p]) + left.radii[q] * right.norms[p]
        most += right.radii[p] * left.norms[q] + left.radii[q] * right.radii[p]
        return most + 1e-9 * (1 + left.norms[q] + left.radii[q]) * (1 + right.norms[p] + right.radii[p])

    stack = [(bound(0, 0), 0, 0)]
    while stack:
        most, q, p = stack.pop()
        mine = left.members[q]
        if most < best.worst[mine].min():
            continue
        if left.children[q] and (left.radii[q] >= right.radii[p] or not right.children[p]):
            below = [(bound(c, p), c, p) for c in left.children[q]]
        elif right.children[p]:
            below = [(bound(q, c), q, c) for c in right.children[p]]
        else:
            theirs = right.members[p]
            scores = inner(queries[mine], points[theirs])
            for row, query in enumerate(mine.tolist()):
                line = scores[row]
                take = np.flatnonzero((line >= best.worst[query]).astype(bool)).tolist()
                if not take:
                    continue
                entries = []
                for at in take:
                    point = int(theirs[at])
                    count = counts[point]
                    if ids[point] == query_ids[query] and np.array_equal(points[point], queries[query]):
                        count -= 1
                    if count:
                        entries.append((int(line[at]), ids[point], count))
                if entries:
                    best.offer(query, *map(list, zip(*entries)))
            continue
        stack += sorted(below)
    return best.kept


# -- Spark steps ------------------------------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), dim)


def quantised(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, vector as packed doubles, count) of all rows that take part."""
    vector = F.col(vector_col)
    usable = vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    parts = rows.where(usable).select(F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, dims = [], []
            for v in batch.column(1):
                whole = np.floor(SCALE * np.asarray(v.values, float))
                dims.append(len(whole))
                packed.append(whole.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], ["id", "dim", "vector"]
            )

    packed = parts.mapInArrow(run, "id long, dim int, vector binary")
    return packed.groupBy("id", "dim", "vector").agg(F.count("*").cast("int").alias("count"))


def with_cells(points: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the cell (nearest pivot of the same length) to (id, dim, vector, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if dim in pivots and dim:
                    there = _matrix(batch.column("vector").take(pa.array(rows)), dim)
                    cells[rows] = ((pivots[dim] ** 2).sum(axis=1) - 2 * there @ pivots[dim].T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    return points.mapInArrow(run, "id long, dim int, vector binary, count int, cell int")


def in_blocks(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds a block number within (dim, cell)."""
    sizes = points.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = points.join(F.broadcast(sizes), ["dim", "cell"])  # at most MAX_CELLS rows per vector length
    return dealt.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int")).drop("blocks")


def summaries(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centre, radius) around the mean of each group: sums first, distances second, never a group in one task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            key_rows = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            for key, vector in zip(key_rows, batch.column("vector").to_pylist()):
                entry = held.setdefault(key, [0, None])
                v = np.frombuffer(vector, np.float64)
                entry[0] += 1
                entry[1] = v.copy() if entry[1] is None else entry[1] + v
        columns = [pa.array([k[i] for k in held], pa.int32()) for i in range(len(keys))]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([e[0] for e in held.values()], pa.int64()),
             pa.array([e[1].tobytes() for e in held.values()], pa.binary())],
            [*keys, "n", "sum"],
        )

    key_types = ", ".join(f"{k} int" for k in keys)
    return points.select(*keys, "vector").mapInArrow(sums, f"{key_types}, n long, sum binary")


def centres_of(points: DataFrame, keys: list[str]) -> dict[tuple, tuple[np.ndarray, float]]:
    """{key: (centre, radius)} on the driver; the number of keys is bounded by MAX_CELLS per vector length."""
    totals: dict[tuple, list] = {}
    for row in summaries(points, keys).collect():
        key = tuple(row[k] for k in keys)
        entry = totals.setdefault(key, [0, 0.0])
        entry[0] += row["n"]
        entry[1] = entry[1] + np.frombuffer(row["sum"], np.float64)
    centres = {k: s / n for k, (n, s) in totals.items()}

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, float] = {}
        for batch in batches:
            key_rows = zip(*(batch.column(c).to_pylist() for c in keys))
            for key, vector in zip(key_rows, batch.column("vector").to_pylist()):
                gap = float(np.sqrt(((np.frombuffer(vector, np.float64) - centres[key]) ** 2).sum()))
                held[key] = max(held.get(key, 0.0), gap)
        columns = [pa.array([k[i] for k in held], pa.int32()) for i in range(len(keys))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.float64())], [*keys, "far"])

    key_types = ", ".join(f"{k} int" for k in keys)
    radii: dict[tuple, float] = {}
    for row in points.select(*keys, "vector").mapInArrow(farthest, f"{key_types}, far double").collect():
        key = tuple(row[k] for k in keys)
        radii[key] = max(radii.get(key, 0.0), row["far"])
    return {k: (c, radii[k]) for k, c in centres.items()}


def search_pairs(queries: DataFrame, points: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(q_id, q_vector, id, score, count): best entries of each query in each paired (query block, cell).

    ``pairs`` holds (dim, q_cell, cell). Every task sees one query block and one point block.
    """
    blocks = points.select("dim", "cell", "block").distinct()
    q_blocks = queries.select("dim", F.col("cell").alias("q_cell"), F.col("block").alias("q_block")).distinct()
    jobs = pairs.join(blocks, ["dim", "cell"]).join(q_blocks, ["dim", "q_cell"])
    key = ["dim", "q_cell", "q_block", "cell", "block"]
    left = queries.select(
        "dim", F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), "id", "vector", "floor"
    ).join(jobs, ["dim", "q_cell", "q_block"])
    right = points.join(jobs, ["dim", "cell", "block"])
    right = right.select("id", "vector", "count", *(F.col(c).alias(f"p_{c}") for c in key))

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("q_id", "q_vector", "id", "score", "count")}
        if q.num_rows and p.num_rows:
            dim = q.column("dim")[0].as_py()
            q = q.sort_by([("id", "ascending"), ("vector", "ascending")])
            p = p.sort_by([("id", "ascending"), ("vector", "ascending")])
            q_ids, q_packed = q.column("id").to_pylist(), q.column("vector").to_pylist()
            kept = search(
                _matrix(q.column("vector"), dim), q_ids, q.column("floor").to_pylist(),
                _matrix(p.column("vector"), dim), p.column("id").to_pylist(), p.column("count").to_pylist(), k,
            )
            for i, entries in enumerate(kept):
                for minus, none, near, count in entries:
                    out["q_id"].append(q_ids[i])
                    out["q_vector"].append(q_packed[i])
                    out["id"].append(None if none else near)
                    out["score"].append(max(-(1 << 63), min((1 << 63) - 1, -minus)))
                    out["count"].append(count)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})

    return left.groupBy(key).cogroup(right.groupBy([f"p_{c}" for c in key])).applyInArrow(
        run, "q_id long, q_vector binary, id long, score long, count int"
    )


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked; counts become rows."""
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)))))
    order = Window.partitionBy("q_id", "q_vector").orderBy(F.desc("score"), F.asc_nulls_last("id"), "copy")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """Rows (query_id, rank, id, score): the k highest inner products of each row that meets ``is_query``."""
    spark = rows.sparkSession
    points = cut_lineage(quantised(rows, id_col, vector_col))
    chosen = cut_lineage(quantised(rows.where(is_query), id_col, vector_col))
    pivots, q_pivots = {}, {}
    for dim, n in points.groupBy("dim").count().collect():  # one row per vector length
        cells = max(1, min(MAX_CELLS, math.ceil(n / (2 * block))))
        first = points.where(F.col("dim") == dim).orderBy(F.md5(F.col("id").cast("string")), "vector").limit(cells)
        pivots[dim] = _matrix(pa.array([r.vector for r in first.select("vector").collect()], pa.binary()), dim)
        q_cells = max(1, min(MAX_CELLS, math.ceil(chosen.where(F.col("dim") == dim).count() / block)))
        q_pivots[dim] = pivots[dim][:q_cells]
    points = cut_lineage(in_blocks(with_cells(points, pivots), block))
    queries = cut_lineage(in_blocks(with_cells(chosen, q_pivots), block))
    cells, q_cells = centres_of(points, ["dim", "cell"]), centres_of(queries, ["dim", "cell"])
    if not q_cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def most(q: tuple, p: tuple) -> float:
        (qc, qr), (pc, pr) = q, p
        qn, pn = float(np.sqrt((qc**2).sum())), float(np.sqrt((pc**2).sum()))
        return (float(qc @ pc) + qr * pn + pr * qn + qr * pr) + 1e-6 * (1 + qn + qr) * (1 + pn + pr)

    pairs = [(d, qc, c) for d, qc in q_cells for d2, c in cells if d2 == d]
    home = {q: max(((most(v, cells[p]), p[1]) for p in cells if p[0] == q[0]))[1] for q, v in q_cells.items()}
    shape = "dim int, q_cell int, cell int"
    first_pairs = spark.createDataFrame([p for p in pairs if home[p[:2]] == p[2]], shape)
    floorless = queries.withColumn("floor", F.lit(None).cast("long"))
    first = cut_lineage(best_of(search_pairs(floorless, points, first_pairs, k), k))
    floors = first.where(F.col("rank") == k).select(
        F.col("q_id").alias("id"), F.col("q_vector").alias("vector"), F.col("score").alias("floor")
    )
    known = cut_lineage(queries.join(floors, ["id", "vector"], "left"))
    lowest = {
        (r.dim, r.cell): r.low for r in known.groupBy("dim", "cell").agg(
            F.min(F.coalesce("floor", F.lit(-(1 << 63)))).alias("low")
        ).collect()
    }
    rest = [p for p in pairs if home[p[:2]] != p[2] and most(q_cells[p[:2]], cells[(p[0], p[2])]) >= lowest[p[:2]]]
    second = search_pairs(known, points, spark.createDataFrame(rest, shape), k)
    columns = ["q_id", "q_vector", "id", "score", "count"]
    found = best_of(first.select(*columns[:-1]).withColumn("count", F.lit(1)).unionByName(second.select(columns)), k)
    # a query row that is repeated is answered as often
    times = chosen.select(F.col("id").alias("q_id"), F.col("vector").alias("q_vector"), F.col("count").alias("times"))
    return (
        found.join(times, ["q_id", "q_vector"])
        .withColumn("again", F.explode(F.sequence(F.lit(1), "times")))
        .select(F.col("q_id").alias("query_id"), F.col("rank").cast("int").alias("rank"),
                F.col("id").alias("vec_id"), "score")
    )
