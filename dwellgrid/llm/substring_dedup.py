"""Substring dedup: words of passages that occur again, in the same document or another, are removed.

A window is ``WINDOW`` consecutive words; words covered by a window that also starts elsewhere go.

1. Anchors. Positions of a document are taken modulo a period; a difference cover of the period is a set of residues in
   which every difference occurs, so for any two positions one shift below the period puts both on the cover. Only the
   windows of ``WINDOW - period + 1`` words that start on the cover are hashed: two equal windows of ``WINDOW`` words
   always share one of these anchors at the same place within them.
2. Extension. Every window that holds a shared anchor is hashed as a whole (96 bits); those that occur again are marked,
   and the words below the marks go. Windows are judged on the input.

Texts are dealt into shards of about ``SHARD_BYTES`` by a hash of text and id and shuffled once; the three passes over
them (anchors, windows, result) read the same exchange. A shard sends each of its hashes once, or twice if it repeats
within the shard, packed by hash range, and gets back those that were sent more than once, so a passage that a third of
all rows share costs two hashes per shard, and no pair of documents is ever formed. Ranges hold about ``RANGE_HASHES``
hashes.

Defined results: null, empty and blank texts have no words and nothing removed; their kept text is empty. Every input
row gives one row and counts as a document of its own, so repeated rows remove each other; ids are only carried along.
Kept words are joined by one space. Rows that agree in id and text share a shard. Tables without rows give no rows.
Columns beyond id and text are not read. Two different windows of the corpus are taken for equal with a probability
below 2^-90 per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.text import WordHasher, mix64, slices, text_bytes

WINDOW = 35
SHARD_BYTES = 6 << 20
LEAST_SHARDS = 64
SHARDS_PER_TASK = 4
RANGE_HASHES = 1 << 20
WORD_BYTES = 6  # of a word and its space, for sizes only
# perfect difference sets: every difference modulo the period occurs exactly once
COVERS = {1: [0], 3: [0, 1], 7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [0, 1, 3, 8, 12, 18]}
LANES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))  # odd
OTHER = np.uint64(0x2545F4914F6CDD1D)


def cover_of(window: int) -> tuple[int, np.ndarray]:
    """(period, residue is in the cover): the longest period that leaves anchors two fifths of the window."""
    period = max(p for p in COVERS if p == 1 or 5 * (window - p + 1) >= 2 * window)
    chosen = np.zeros(period, bool)
    chosen[COVERS[period]] = True
    return period, chosen


# -- hashes of one shard ----------------------------------------------------------------------------------------------


class Rolling:
    """Hashes of equally long runs of words by prefix sums over odd powers modulo 2^64."""

    def __init__(self, multiplier: np.uint64):
        self.multiplier = multiplier
        self.inverse = np.uint64(pow(int(multiplier), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 1 << 16)
            for name, step in (("powers", self.multiplier), ("inverses", self.inverse)):
                steps = np.full(n, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def of(self, hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        self._grow(len(hashes))
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[:len(hashes)])))
            return mix64((sums[starts + width] - sums[starts]) * self.inverses[starts])


class Passage:
    """Words of some documents one after another: hash, place within the document and words of that document."""

    def __init__(self, texts: list[bytes], hasher: WordHasher):
        self.words = [t.split() for t in texts]  # at 0x20 and 0x09-0x0D
        self.counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.hashes = hasher.words([w for words in self.words for w in words])
        self.begins = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(self.hashes)) - np.repeat(self.begins, self.counts)
        self.size = np.repeat(self.counts, self.counts)


class Shard:
    """Anchors and windows of the texts of one shard, read in portions."""

    def __init__(self, texts: pa.ChunkedArray, window: int):
        self.texts, self.window = texts, window
        self.period, self.cover = cover_of(window)
        self.anchor = window - self.period + 1
        self.hasher = WordHasher()
        self.lanes = [Rolling(m) for m in LANES]

    def passages(self) -> Iterator[Passage]:
        for chunk in self.texts.chunks:
            texts = text_bytes(chunk)
            for part in slices(texts):
                yield Passage(texts[part], self.hasher)

    def anchors(self, words: Passage) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the anchors of documents that hold a window."""
        on_cover = self.cover[words.place % self.period] & (words.place <= words.size - self.anchor)
        starts = np.flatnonzero(on_cover & (words.size >= self.window))
        return starts, self.lanes[0].of(words.hashes, starts, self.anchor)

    def around(self, words: Passage, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of these anchors."""
        first = shared - np.minimum(words.place[shared], self.window - self.anchor)
        last = shared - np.maximum(words.place[shared] - (words.size[shared] - self.window), 0)
        return np.flatnonzero(spread(first, last + 1, len(words.hashes)))

    def whole(self, words: Passage, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and further 32 hash bits of the windows at these starts."""
        one = self.lanes[0].of(words.hashes, starts, self.window)
        two = self.lanes[1].of(mix64(words.hashes ^ OTHER), starts, self.window)
        return one, (two >> np.uint64(32)).astype(np.uint32)


def spread(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in [begin, end) of any pair."""
    steps = np.bincount(begins, minlength=n + 1)[:n + 1] - np.bincount(ends, minlength=n + 1)[:n + 1]
    return np.cumsum(steps)[:n] > 0


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def like_the_next(low: np.ndarray, high: np.ndarray | None) -> np.ndarray:
    """For each but the last of sorted entries, whether it equals the next."""
    same = low[1:] == low[:-1]
    return same if high is None else same & (high[1:] == high[:-1])


def in_order(low: np.ndarray, high: np.ndarray | None) -> np.ndarray:
    return np.argsort(low, kind="stable") if high is None else np.lexsort((high, low))


def at_most_twice(low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorted entries, those that repeat only twice."""
    order = in_order(low, high)
    low, high = low[order], None if high is None else high[order]
    same = like_the_next(low, high)
    kept = np.ones(len(low), bool)
    kept[2:] = ~(same[1:] & same[:-1])
    return low[kept], None if high is None else high[kept]


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def in_ranges(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(range numbers, offsets) of sorted hashes dealt into equal ranges."""
    number = ((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    numbers, begins = np.unique(number, return_index=True)
    return numbers.astype(np.int64), np.concatenate((begins, [len(hashes)]))


# -- Spark steps ------------------------------------------------------------------------------------------------------

PACKED = "range long, shard long, low binary, high binary"
FOUND = "home long, low binary"


def packed_rows(shard: int, low: np.ndarray, high: np.ndarray | None, ranges: int) -> pa.Table:
    """One row per range with the sorted hashes of a shard."""
    numbers, offsets = in_ranges(low, ranges)
    cuts = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    return pa.table({
        "range": pa.array(numbers, pa.int64()), "shard": pa.array(np.full(len(numbers), shard), pa.int64()),
        "low": pa.array([low[i:j].tobytes() for i, j in cuts], pa.binary()),
        "high": pa.array([None if high is None else high[i:j].tobytes() for i, j in cuts], pa.binary()),
    })


def unpacked(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, number of values per row)."""
    rows = [np.frombuffer(b, kind) for b in table.column(column).to_pylist() if b is not None]
    return joined(rows, kind), np.fromiter(map(len, rows), np.int64, len(rows))


def met_again(rows: pa.Table) -> pa.Table:
    """The hashes of one range that were sent more than once, back to the shards that sent them."""
    low, sizes = unpacked(rows, "low", np.uint64)
    high = unpacked(rows, "high", np.uint32)[0] if rows.column("high").null_count == 0 else None
    owners = np.repeat(rows.column("shard").to_numpy(), sizes)
    order = in_order(low, high)
    low, owners = low[order], owners[order]
    same = like_the_next(low, None if high is None else high[order])
    again = np.concatenate((same, [False])) | np.concatenate(([False], same))
    low, owners = low[again], owners[again]
    order = np.argsort(owners, kind="stable")
    shards, begins = np.unique(owners[order], return_index=True)
    cuts = [*begins.tolist(), len(owners)]
    low = low[order]
    return pa.table({
        "home": pa.array(shards, pa.int64()),
        "low": pa.array([low[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
    })


def known_hashes(found: pa.Table) -> np.ndarray:
    return np.unique(unpacked(found, "low", np.uint64)[0])


def sent_again(packed: DataFrame) -> DataFrame:
    return packed.groupBy("range").applyInArrow(met_again, FOUND)


def in_shards(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, text, shard) behind one shuffle, and the number of bytes of all texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    shards = max(LEAST_SHARDS, math.ceil(size / SHARD_BYTES))
    shard = F.pmod(F.xxhash64("text", "id"), F.lit(shards)).alias("shard")
    return rows.select("id", "text", shard).repartition(math.ceil(shards / SHARDS_PER_TASK), "shard"), size


def drop_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Rows (id, n_words, n_removed, kept), one per document; ``kept`` holds the words that stay."""
    dealt, size = in_shards(docs, id_col, text_col)
    ranges = max(1, math.ceil(size / WORD_BYTES / RANGE_HASHES))

    def anchor_hashes(rows: pa.Table) -> pa.Table:
        shard = Shard(rows.column("text"), window)
        found = [at_most_twice(shard.anchors(words)[1])[0] for words in shard.passages()]
        return packed_rows(rows.column("shard")[0].as_py(), *at_most_twice(joined(found, np.uint64)), ranges)

    def window_hashes(rows: pa.Table, found: pa.Table) -> pa.Table:
        shard, known = Shard(rows.column("text"), window), known_hashes(found)
        low, high = [], []
        for words in shard.passages() if len(known) else ():
            starts, hashes = shard.anchors(words)
            parts = shard.whole(words, shard.around(words, starts[in_sorted(hashes, known)]))
            low.append(parts[0])
            high.append(parts[1])
        held = at_most_twice(joined(low, np.uint64), joined(high, np.uint32))
        return packed_rows(rows.column("shard")[0].as_py(), *held, ranges)

    def without_repeats(rows: pa.Table, found: pa.Table) -> pa.Table:
        shard, known = Shard(rows.column("text"), window), known_hashes(found)
        counts, removed, kept = [], [], []
        for words in shard.passages():
            starts = np.flatnonzero(words.place <= words.size - window)
            gone = starts[in_sorted(shard.whole(words, starts)[0], known)]
            cut = spread(gone, gone + window, len(words.hashes))
            ends = words.begins + words.counts
            for tokens, begin, end in zip(words.words, words.begins.tolist(), ends.tolist()):
                out = cut[begin:end]
                n = int(out.sum())
                kept.append(b" ".join(compress(tokens, (~out).tolist()) if n else tokens))
                counts.append(end - begin)
                removed.append(n)
        return pa.table({
            "id": rows.column("id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    by_shard = dealt.groupBy("shard")
    anchors = sent_again(by_shard.applyInArrow(anchor_hashes, PACKED))
    windows = sent_again(by_shard.cogroup(anchors.groupBy("home")).applyInArrow(window_hashes, PACKED))
    kind = dealt.schema["id"].dataType.simpleString()
    shape = f"id {kind}, n_words long, n_removed long, kept string"
    result = by_shard.cogroup(windows.groupBy("home")).applyInArrow(without_repeats, shape)
    return result.withColumnRenamed("id", id_col)
