"""Language identification by a byte convolutional network.

The network reads fixed windows of ``WINDOW`` bytes. Filters of two, three and four bytes run over a window, the largest
answer of each filter is kept (max pooling), and a softmax layer gives the languages' probabilities. A document's
probabilities are the mean over all windows of its whole text, weighted by their bytes. A filter over bytes is a sum of
table rows, so the application looks rows up for pairs of bytes instead of multiplying.

The network is trained in numpy on the driver on a bounded sample: at most ``SAMPLE_PER_LANGUAGE`` documents of each
language and ``SAMPLE_TOTAL`` in all, in the order of a hash of the id, one window each from a place anywhere in the
text. Documents whose crc32 of the id leaves 2 modulo 4 are held out, and so are documents without id or language.

Defined results: a null text and a text without a letter are ``und`` with score 0; so is every text when nothing can be
learned. Repeated rows are predicted alike; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.llm.text import bounded_batches, learnable_part, portions, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE_PER_LANGUAGE = 1500
SAMPLE_TOTAL = 20_000
STEPS = 500
BATCH = 64
UNKNOWN = "und"
CHUNK = 1 << 18


def windows(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows as rows of bytes, each window's share of real bytes, number of windows of each text)."""
    counts = np.array([-(-len(t) // length) for t in texts], np.int64)
    data = b"".join([t.ljust(n * length, b"\0") for t, n in zip(texts, counts.tolist())])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(counts.sum())
    filled = np.full(total, float(length))
    some = counts > 0
    filled[np.cumsum(counts)[some] - 1] = (sizes - (counts - 1) * length)[some]
    return np.frombuffer(data, np.uint8).reshape(total, length), filled, counts


class ByteConvNet:
    """Filters over bytes, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def _places(self, length: int) -> int:
        return length - max(WIDTHS) + 1

    def fit(self, rows: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 8) -> ByteConvNet:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.bias, self.dense, self.shift]
        means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        places = self._places(rows.shape[1])
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(rows), BATCH)
            x, y = rows[pick].astype(np.intp), labels[pick]
            best, answers = [], []
            for table, width in zip(self.filters, WIDTHS):
                out = table[0][x[:, :places]]
                for k in range(1, width):
                    out += table[k][x[:, k:k + places]]
                best.append(out.argmax(axis=1))
                answers.append(np.take_along_axis(out, best[-1][:, None], 1)[:, 0])
            hidden = np.maximum(np.concatenate(answers, axis=1) + self.bias, 0)
            slope = softmax(hidden @ self.dense + self.shift)
            slope[np.arange(BATCH), y] -= 1
            slope /= BATCH
            back = (slope @ self.dense.T) * (hidden > 0)
            grads = []
            for i, (table, width) in enumerate(zip(self.filters, WIDTHS)):
                grad = np.zeros_like(table)
                mine = back[:, i * FILTERS:(i + 1) * FILTERS]
                for k in range(width):
                    byte = np.take_along_axis(x, best[i] + k, 1)
                    np.add.at(grad[k], (byte, np.arange(FILTERS)[None, :]), mine)
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, s in zip(params, grads, means, squares):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by byte pair for the first two bytes of each filter, by byte for the third of width 3, by pair for the
        last two of width 4."""
        two, three, four = self.filters
        first = np.concatenate([
            (t[0][:, None, :] + t[1][None, :, :]).reshape(65536, FILTERS) for t in (two, three, four)
        ], axis=1)
        return first, three[2], (four[2][:, None, :] + four[3][None, :, :]).reshape(65536, FILTERS)

    def predict(self, rows: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Probabilities per window."""
        first, third, last = tables
        x = np.ascontiguousarray(rows.T)
        pairs = (x[:-1].astype(np.intp) << 8) | x[1:]
        best = np.full((rows.shape[0], first.shape[1]), -np.inf, np.float32)
        out = np.empty_like(best)
        for at in range(self._places(rows.shape[1])):
            np.take(first, pairs[at], axis=0, out=out, mode="clip")
            out[:, FILTERS:2 * FILTERS] += third[x[at + 2]]
            out[:, 2 * FILTERS:] += last[pairs[at + 2]]
            np.maximum(best, out, out=best)
        return softmax(np.maximum(best + self.bias, 0) @ self.dense + self.shift)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE, total: int = SAMPLE_TOTAL,
) -> ByteConvNet | None:
    """The network trained on the bounded sample, None if there is nothing to learn."""
    may_learn, _ = learnable_part(id_col)
    rows = docs.where(may_learn & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.md5(F.col(id_col).cast("string")).alias("draw"),
    )
    # the first of a language are among the first of their bucket, so no task ranks a whole language
    bucket = F.substring("draw", -2, 2)
    sample = rows.select(
        F.col("id").alias("s_id"), F.col("lang").alias("s_lang"), F.col("draw").alias("s_draw"), bucket.alias("bucket")
    ).distinct()  # rows that repeat an id are drawn together
    for keys in (["s_lang", "bucket"], ["s_lang"]):
        order = Window.partitionBy(*keys).orderBy("s_draw", "s_id")
        sample = sample.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    sample = sample.orderBy("place", "s_draw", "s_id").limit(total).select("s_id").distinct()
    text = F.col("text")
    start = F.pmod(F.xxhash64("draw"), F.greatest(F.length(text) - WINDOW + 1, F.lit(1))) + 1
    picked = (
        rows.where(F.length(text) > 0).join(F.broadcast(sample), F.col("id") == F.col("s_id"))  # at most ``total`` ids
        .select("lang", "draw", text.substr(start.cast("int"), F.lit(WINDOW)).alias("part"))
        .orderBy("draw", "lang", "part").limit(total).toArrow()
    )
    labels = picked.column("lang").to_pylist()
    if not labels:
        return None
    languages = sorted(set(labels))
    parts = [t.encode().lower()[:WINDOW].ljust(WINDOW, b"\0") for t in picked.column("part").to_pylist()]
    data = np.frombuffer(b"".join(parts), np.uint8).reshape(len(parts), WINDOW)
    known = {lang: i for i, lang in enumerate(languages)}
    return ByteConvNet(languages).fit(data, np.array([known[x] for x in labels]))


def predict_languages(
    docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, held_out, lang_pred, score), one per input row."""
    _, held = learnable_part(id_col)
    bounded_batches(docs.sparkSession)
    has_letter = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    text = F.when(has_letter, F.col(text_col)) if net is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col), held.alias("held_out"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net is not None else None
        for batch, texts in portions(batches, 2):
            texts = [t.lower() for t in texts]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for part in slices(texts, CHUNK):
                data, filled, counts = windows(texts[part])
                if not len(data):
                    continue
                sums = [net.predict(data[i:i + CHUNK // WINDOW], tables) for i in range(0, len(data), CHUNK // WINDOW)]
                sums = np.concatenate(sums) * filled[:, None]
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                shares = np.add.reduceat(sums, starts) / np.add.reduceat(filled, starts)[:, None]
                top = shares.argmax(axis=1)
                for i, best, share in zip((some + part.start).tolist(), top.tolist(), shares.tolist()):
                    names[i], scores[i] = net.languages[best], min(1.0, share[best])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                [*batch.schema.names[:2], "lang_pred", "score"],
            )

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
