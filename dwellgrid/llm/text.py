"""Byte-level helpers for operators that read whole texts inside tasks.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D; these bytes never occur inside a longer UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]"
WORDS = "[^\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
SPACE = 32


def learnable_part(doc_id: str, folds: int = 4, held: int = 2) -> tuple[Column, Column]:
    """(may be learned from, is held out) by crc32 of the id as text; a null id is neither."""
    fold = F.crc32(F.col(doc_id).cast("string")) % folds
    return F.coalesce(fold != held, F.lit(False)), F.coalesce(fold == held, F.lit(False))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the batches that go to Python tasks at ``BATCH_BYTES``; a session that asks for less keeps its setting."""
    asked = spark.conf.get(BATCH_CONF, "64m").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(asked[-1:], 1)
    if int(asked.rstrip("kmg")) * unit > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def portions(
    batches: Iterator[pa.RecordBatch], text_at: int, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of about ``limit`` text bytes with their texts, so that a task never copies a whole batch of long
    texts; a longer text comes alone."""
    for batch in batches:
        column = batch.column(text_at)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(begin, end - begin), text_bytes(column.slice(begin, end - begin))
            begin = end
    pa.default_memory_pool().release_unused()


def slices(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Consecutive rows of about ``limit`` bytes; a longer row stands alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def pieces(words: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """Words joined by single spaces, as byte arrays of about ``limit`` bytes that end at word ends."""
    if sum(map(len, words)) + len(words) <= 2 * limit:
        if words:
            yield np.frombuffer(b" ".join(words), np.uint8)
        return
    for part in slices(words, limit):
        yield np.frombuffer(b" ".join(words[part]), np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words: random values per byte weighted by odd powers of the place within the word."""

    STEP = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, seed: int = 20):
        self.values = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.values[SPACE] = 0
        self.powers = np.ones(1, np.uint64)

    def _grow(self, length: int) -> None:
        if length > len(self.powers):
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.full(max(length, 64), self.STEP | np.uint64(5), np.uint64))

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the words of a piece."""
        gaps = np.flatnonzero(data == SPACE)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(data)]))
        spans = np.diff(np.concatenate((starts, [len(data)])))
        self._grow(int(spans.max()))
        place = np.arange(len(data)) - np.repeat(starts, spans)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(self.values[data] * self.powers[place], starts)
            return mix64(sums), starts, ends

    def words(self, words: list[bytes]) -> np.ndarray:
        found = [self.of(piece)[0] for piece in pieces(words)]
        return np.concatenate(found) if found else np.empty(0, np.uint64)
