"""Near-duplicate detection with SetSketch registers.

A document's set holds the distinct shingles of ``SHINGLE`` words (words lower-cased in A-Z; a shorter text is one
shingle). Documents are linked when the Jaccard similarity of their sets is at least ``THRESHOLD`` percent; the result
is the connected components of these links.

1. Copies: documents with the same word sequence are one node, found by a digest with map-side combine.
2. Sketch: each shingle is the source of a Poisson stream of arrivals that fall on ``REGISTERS`` registers; a register
   keeps its smallest arrival time t as floor(1 - log_b t), truncated to 16 bits. Registers of a union are the maxima, so
   sketches merge; a register agrees in two sketches about as often as the sets agree. Arrivals come in rising order, so
   a shingle's stream is followed only up to the time by which all registers are filled.
3. Candidates: ``BANDS`` bands of registers; nodes that agree in a band share a bucket. Each node of a bucket is paired
   with the bucket's smallest node only. With 32 bands of 4 registers a pair at 0.75 shares no bucket with probability
   (1 - 0.75^4)^32, about 5e-6.
4. Estimate: the joint likelihood of the registers that are greater, smaller and equal, given both set sizes. Pairs whose
   estimate lies below ``SURELY_LOWER`` (over six standard deviations under the threshold) or whose sizes forbid the
   threshold go.
5. Verify: the rest is decided on the full sets, and links become components by alternating large and small stars.
6. What is left: only pairs of one bucket that are in different components can still matter. They are compared block
   against block on finer sketches of ``FINE`` registers (one byte each), which only nodes that share a bucket get. Pairs
   that agree too rarely for the threshold by ``FINE_SIGMAS`` standard deviations go, a pair that meets in several bands
   is taken in the first, and the rest is verified; then the components are closed again. No list of all pairs of a
   bucket ever exists, and there is no cap on buckets, partners or candidates.

Defined results: null, empty and wordless texts have an empty set and stand alone under their own id; a component's id
is its smallest id, null last (null if all are null); rows that repeat an id share its component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.text import WordHasher, bounded_batches, mix64, portions
from dwellgrid.session import cut_lineage

SHINGLE = 5
THRESHOLD = 75
REGISTERS = 128
BANDS = 32
BASE = 1.02
RATE = 20.0
TOP = (1 << 16) - 1
SURELY_LOWER = 0.5
FINE = 1024
FINE_SIGMAS = 4.5
BLOCK = 512
BROADCAST_NODES = 500_000
LINKS_PER_TASK = 500_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# -- sets and sketches ------------------------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts one after the other, number of each text's)."""
    hasher = WordHasher()
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = hasher.words([w for ws in words for w in ws])
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        weights = mix64(np.arange(1, size + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
        rolled = np.zeros(len(flat), np.uint64)
        for k in range(size):
            rolled[: len(flat) - k] += flat[k:] * weights[k]
        rolled = mix64(rolled)
        sets, sizes = [], np.zeros(len(texts), np.int64)
        for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
            if n == 0:
                continue
            if n < size:
                part = mix64(np.array([(flat[end - n:end] * weights[:n]).sum() + np.uint64(n)]))
            else:
                part = np.unique(rolled[end - n:end - size + 1])
            sets.append(part)
            sizes[i] = len(part)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), sizes


def sketches(hashes: np.ndarray, sizes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of each set, (sets, registers) unsigned 16 bit; empty sets have zeros."""
    sets = len(sizes)
    times = np.full(sets * registers, np.inf)
    owner = np.repeat(np.arange(sets), sizes)
    # by this time a set's registers are all filled, but for a fraction e^-6 of the sets, which get more time
    limit = (np.log(registers) + 6) / (RATE * np.maximum(sizes, 1))
    todo = np.flatnonzero(sizes)
    while len(todo):
        mask = np.zeros(sets, bool)
        mask[todo] = True
        pick = np.flatnonzero(mask[owner])
        state, of, now = hashes[pick], owner[pick], np.zeros(len(pick))
        while len(state):
            with np.errstate(over="ignore"):
                state = state + GOLDEN
            draw = mix64(state)
            now = now - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / (RATE * registers)
            place = of * registers + (mix64(draw) % np.uint64(registers)).astype(np.int64)
            on = now <= limit[of]
            state, of, now, place = state[on], of[on], now[on], place[on]
            np.minimum.at(times, place, now)
        open_ = np.isinf(times.reshape(sets, registers)[todo]).any(axis=1)
        todo = todo[open_]
        limit[todo] *= 2
    times = times.reshape(sets, registers)
    with np.errstate(divide="ignore"):
        values = np.floor(1 - np.log(times) / np.log(BASE))
    return np.where(np.isinf(times), 0, np.clip(values, 0, TOP)).astype(np.uint16)


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key per band and sketch."""
    rows = registers.reshape(len(registers), bands, -1).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.full(rows.shape[:2], 1, np.uint64) * (np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN)
        for k in range(rows.shape[2]):
            key = mix64(key + rows[:, :, k] + np.uint64(1))
    return key.view(np.int64)


def likely(greater: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """True where the likelihood's maximum over the similarity is not below ``SURELY_LOWER`` and sizes allow a link.

    The log-likelihood is concave in the similarity, so its slope at that point tells on which side the maximum lies.
    """
    a, b = n_a / (n_a + n_b), n_b / (n_a + n_b)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def logarithm(j: float) -> np.ndarray:
        more, less = chance(np.maximum(a - b * j, 1e-12)), chance(np.maximum(b - a * j, 1e-12))
        same = np.maximum(1 - more - less, 1e-12)
        return greater * np.log(more) + smaller * np.log(less) + equal * np.log(same)

    allowed = np.minimum(n_a, n_b) * 100 >= THRESHOLD * np.maximum(n_a, n_b)
    return allowed & (logarithm(SURELY_LOWER + 1e-4) >= logarithm(SURELY_LOWER))


def may_reach(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """True where so many equal fine registers leave the threshold possible, given both set sizes."""
    j = THRESHOLD / 100
    a, b = n_a / (n_a + n_b), n_b / (n_a + n_b)
    more, less = (-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE) for x in (a - b * j, b - a * j))
    p = np.clip(1 - more - less, 0, 1)
    allowed = np.minimum(n_a, n_b) * 100 >= THRESHOLD * np.maximum(n_a, n_b)
    return allowed & (equal >= FINE * p - FINE_SIGMAS * np.sqrt(FINE * p * (1 - p)) - 1)


# -- Spark steps ------------------------------------------------------------------------------------------------------


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, text): the hash of the raw text finds a row's text again in a later scan."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("raw"), F.col(text_col).alias("text"))


def sequence_digests(texts: list[bytes]) -> list[bytes | None]:
    """Digest of each word sequence, None without words."""
    joined = (b" ".join(t.lower().split()) for t in texts)
    return [hashlib.md5(j, usedforsecurity=False).digest() if j else None for j in joined]


def sketch_documents(rows: DataFrame) -> DataFrame:
    """(id, raw, node, n, sketch, keys) from (id, raw, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, 2):
            hashes, sizes = shingle_sets(texts)
            found = sketches(hashes, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sequence_digests(texts), pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in found], pa.binary()),
                 pa.array(list(band_keys(found)), pa.list_(pa.int64()))],
                ["id", "raw", "node", "n", "sketch", "keys"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, raw long, node binary, n long, sketch binary, keys array<long>")


def estimate_pairs(pairs: DataFrame) -> DataFrame:
    """Those (a, b) of (a, b, n_a, n_b, s_a, s_b) whose estimate leaves a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                for c in ("s_a", "s_b")
            )
            greater, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
            sizes = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            keep = likely(greater, smaller, a.shape[1] - greater - smaller, *sizes)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a binary, b binary")


def verify_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) whose full sets reach the threshold; ``sets`` holds (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of a task as links of each node to the least node it is connected with."""
    ends: list[list[np.ndarray]] = [[], []]
    for batch in batches:
        for side, column in zip(ends, ("a", "b")):
            side.append(np.frombuffer(b"".join(batch.column(column).to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64))
    if not ends[0]:
        return
    packed = np.concatenate([*ends[0], *ends[1]])
    order = np.lexsort((packed[:, 1], packed[:, 0]))
    new = np.concatenate(([True], (packed[order][1:] != packed[order][:-1]).any(axis=1)))
    number = np.empty(len(packed), np.int64)
    number[order] = np.cumsum(new) - 1
    nodes = packed[order][new]
    a, b = np.split(number, 2)
    least = np.arange(len(nodes))
    while (least[a] != least[b]).any():
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        np.minimum.at(least, high, low)
        while (least[least] != least).any():
            least = least[least]
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    for begin in range(0, len(moved), 1 << 16):
        part = moved[begin:begin + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([n.tobytes() for n in nodes[rows].astype(">u8")], pa.binary()) for rows in (part, least[part])],
            ["a", "b"],
        )


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all linked nodes from links (a, b) of 16-byte nodes.

    Tasks of up to ``LINKS_PER_TASK`` links contract what they hold, without a shuffle; one task finishes few links.
    More go through alternating stars between the contractions until nothing changes; each round is written once."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        wanted = both.where("b > a") if large else both.where("b < a")
        moved = wanted.join(near, "a").select(F.col("b").alias("v"), "m")
        if not large:
            moved = moved.unionByName(near.select(F.col("a").alias("v"), "m"))
        return moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    last = mark(edges)
    while last[0]:
        tasks = -(-last[0] // LINKS_PER_TASK)
        edges = edges.coalesce(tasks).mapInArrow(contracted, "a binary, b binary")
        edges = cut_lineage(edges if tasks == 1 else star(star(edges, True), False))
        if tasks == 1 or (now := mark(edges)) == last:
            break
        last = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def cross_pairs(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) within buckets but across components, from (key, node, root, n, fine, keys).

    A bucket's nodes are dealt into blocks; each task compares two blocks on their sketches, so neither a whole bucket
    nor its list of pairs is ever held.
    """
    sizes = members.groupBy("key").agg(
        F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low <> high").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = dealt.withColumn("other", F.explode(others)).select(
        "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "root",
        "n", "fine", "keys",
    )

    def compare(table: pa.Table) -> pa.Table:
        bucket, one, two = (table.column(c)[0].as_py() for c in ("key", "one", "two"))
        block, n = table.column("block").to_numpy(), table.column("n").to_numpy().astype(float)
        nodes = table.column("node").to_pylist()
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(len(n), -1)
        keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(len(n), -1)
        band = int(np.argmax((keys == bucket).all(axis=0)))
        label = np.unique(np.array([r.hex() for r in table.column("root").to_pylist()]), return_inverse=True)[1]
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        out_a, out_b = [], []
        for i in left:
            them = right[(label[right] != label[i]) & ((right > i) if one == two else True)]
            them = them[~(keys[them, :band] == keys[i, :band]).any(axis=1)]  # the others met in an earlier band
            them = them[may_reach((fine[them] == fine[i]).sum(axis=1), np.full(len(them), n[i]), n[them])]
            for j in them:
                low, high = sorted((nodes[i], nodes[j]))
                out_a.append(high)
                out_b.append(low)
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return dealt.groupBy("key", "one", "two").applyInArrow(compare, "a binary, b binary").distinct()


def sets_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles, fine) of the nodes (node, raw) from (raw, text): full sets and fine sketches, one row per node."""
    places = nodes.select("raw").distinct()
    small = places.count() <= BROADCAST_NODES  # eight bytes each
    texts = rows.select("raw", "text").join(F.broadcast(places) if small else places, "raw", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, texts in portions(batches, 0):
            digests = sequence_digests(texts)
            fresh = []
            for i, digest in enumerate(digests):
                if digest is not None and digest not in seen:
                    seen.add(digest)
                    fresh.append(i)
            if not fresh:
                continue
            hashes, sizes = shingle_sets([texts[i] for i in fresh])
            fine = sketches(hashes, sizes, FINE).astype(np.uint8)  # the low byte
            sets = np.split(hashes, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in fresh], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary()),
                 pa.array([r.tobytes() for r in fine], pa.binary())],
                ["node", "shingles", "fine"],
            )

    found = texts.select("text").mapInArrow(run, "node binary, shingles binary, fine binary")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one per input row."""
    return decided(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept"
    )


def decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, node, n, component_id, kept), one per input row."""
    bounded_batches(docs.sparkSession)
    rows = located(docs, id_col, text_col)
    documents = cut_lineage(sketch_documents(rows))
    nodes = cut_lineage(
        documents.where("node is not null").groupBy("node").agg(
            F.min(F.struct("raw", "n", "sketch", "keys")).alias("kept")
        ).select("node", "kept.*")
    )
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    hubs = cut_lineage(
        buckets.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    )
    shared = cut_lineage(buckets.join(hubs, "key").select("key", "node", "hub"))
    members = cut_lineage(nodes.join(shared.select("node").distinct(), "node", "left_semi"))
    sets = cut_lineage(sets_of(rows, members))

    def with_traits(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            named = members.select(
                F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")
            )
            pairs = pairs.join(named, side)
        return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b")

    stars = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = cut_lineage(verify_pairs(estimate_pairs(with_traits(stars)), sets))
    roots = components(links)
    traits = members.select("node", "n", "keys").join(sets.select("node", "fine"), "node").join(roots, "node", "left")
    traits = traits.withColumn("root", F.coalesce("root", "node"))
    rest = cut_lineage(verify_pairs(cross_pairs(shared.select("key", "node").join(traits, "node")), sets))
    if rest.count():
        roots = components(links.unionByName(rest))
    roots = cut_lineage(roots)
    labelled = documents.select("id", "raw", "node", "n").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    firsts = labelled.where("root is not null").groupBy("root").agg(F.min("id").alias("first"))
    return labelled.join(firsts, "root", "left").select(
        "id", "raw", "node", "n",
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("first")).alias("component_id"),
        F.when(F.col("root").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("first"))).alias("kept"),
    )


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without near-duplicates: one row of each component, all wordless rows."""
    found = decided(docs, id_col, text_col).where("kept").groupBy(
        F.col("id").alias("k_id"), F.col("raw").alias("k_raw")
    ).agg(F.count("*").alias("copies"), F.bool_or(F.col("node").isNull()).alias("wordless"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("raw"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    stays = rows.join(found, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("raw") == F.col("k_raw")))
    # only rows that repeat an id and its text meet again
    again = (F.col("copies") > 1) & ~F.col("wordless")
    once = stays.where(again).dropDuplicates(["id", "raw"])
    return stays.where(~again).select("row.*").unionByName(once.select("row.*"))
