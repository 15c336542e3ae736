"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

A word of the text counts as two units: the word itself and its form (kinds of its first, middle and next-to-last byte,
its last byte, and whether it repeats the word before). Units fall into ``2 * UNITS`` buckets. Each bucket has a sparse
random index vector; a bucket's word vector is the sum of the index vectors of the units that stand beside it in the
training texts, brought to length one. A document is the mean of its units' word vectors over its whole text. A network
with one hidden layer, trained in numpy, gives the probability of label 1; its logits are divided by a temperature
chosen on training documents that the network did not see.

Word vectors, network and temperature are fitted on a bounded sample of labelled documents: the first ``SAMPLE`` by a
hash of the id, of those whose crc32 of the id does not leave 2 modulo 4. Labels, language, source and id never enter a
score. Scores are computed for all documents.

Defined results: null, empty and wordless texts are the zero vector, and their score is the network's for it; without
labelled documents every score is 0.5; a null id is not held out and is never learned from. If labels of an id are
repeated, each repetition counts. Repeated rows score alike; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellgrid.llm.text import SPACE, WordHasher, bounded_batches, learnable_part, mix64, pieces, portions, slices
from dwellgrid.session import cut_lineage

UNITS = 1 << 13
DIM = 64
NONZERO = 8
HIDDEN = 32
SAMPLE = 6000
PARTS = 8
EPOCHS = 60
THRESHOLD = 0.7
CHUNK = 1 << 18


def byte_kinds() -> np.ndarray:
    """Kind of each byte: space, lower, upper, digit, other sign, part of a longer character."""
    kinds = np.full(256, 4, np.int64)
    kinds[SPACE] = 0
    kinds[ord("a"):ord("z") + 1] = 1
    kinds[ord("A"):ord("Z") + 1] = 2
    kinds[ord("0"):ord("9") + 1] = 3
    kinds[128:] = 5
    return kinds


KINDS = byte_kinds()


def units(hasher: WordHasher, words: list[bytes], firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their forms; ``firsts`` marks the first word of each text."""
    hashes, forms = [], []
    for data in pieces(words, CHUNK):
        found, starts, ends = hasher.of(data)
        hashes.append(found)
        middle, before_last = (starts + ends) // 2, np.maximum(ends - 2, starts)
        form = (KINDS[data[starts]] * 6 + KINDS[data[middle]]) * 6 + KINDS[data[before_last]]
        forms.append(form * 256 + data[ends - 1])
    word = np.concatenate(hashes)
    repeats = np.concatenate(([False], word[1:] == word[:-1])) & ~firsts
    form = np.concatenate(forms).astype(np.uint64) * np.uint64(2) + repeats.astype(np.uint64)
    size = np.uint64(UNITS)
    return (word % size).astype(np.int64), (mix64(form + np.uint64(1)) % size).astype(np.int64) + UNITS


def tokenised(texts: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words per row, word buckets, form buckets) for runs of rows."""
    hasher = WordHasher()
    for part in slices(texts, CHUNK):
        words = [t.split() for t in texts[part]]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        if not flat:
            yield part, counts, np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        firsts = np.zeros(len(flat), bool)
        firsts[(np.cumsum(counts) - counts)[counts > 0]] = True
        yield part, counts, *units(hasher, flat, firsts)


def index_vectors(seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((2 * UNITS, DIM), np.float32)
    places = rng.random((2 * UNITS, DIM)).argsort(axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (2 * UNITS, NONZERO)), 1)
    return out


def contexts(texts: list[bytes], index: np.ndarray, into: np.ndarray) -> None:
    """Adds to each bucket the index vectors of its neighbours within the same text."""
    for _, counts, word, form in tokenised(texts):
        if not len(word):
            continue
        own = index[word] + index[form]
        near = np.zeros_like(own)
        ends = np.cumsum(counts)
        inner = np.ones(len(own), bool)
        inner[ends[counts > 0] - 1] = False  # no neighbour after the last word of a text
        joins = np.flatnonzero(inner[:-1])
        near[joins] += own[joins + 1]
        near[joins + 1] += own[joins]
        for bucket in (word, form):
            order = np.argsort(bucket, kind="stable")
            ranked = bucket[order]
            starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            into[ranked[starts]] += np.add.reduceat(near[order], starts)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each text."""
    out = np.zeros((len(texts), DIM), np.float32)
    for part, counts, word, form in tokenised(texts):
        if len(word):
            some = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[some]
            sums = np.add.reduceat(vectors[word], starts) + np.add.reduceat(vectors[form], starts)
            out[some + part.start] = sums / counts[some][:, None]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((features - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.logits(pooled(texts, self.vectors)) / self.temperature).astype(float)


def train(vectors: np.ndarray, features: np.ndarray, labels: np.ndarray, seed: int = 6) -> QualityModel:
    """Two-layer network by Adam; every fifth row is kept apart for the temperature."""
    rng = np.random.default_rng(seed)
    model = QualityModel(
        vectors, features.mean(axis=0), features.std(axis=0) + 1e-6,
        [rng.normal(0, 0.1, (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)], 1.0,
    )
    apart = np.arange(len(labels)) % 5 == 4
    x, y = ((features - model.mean) / model.scale)[~apart], labels[~apart].astype(float)
    means, squares = [np.zeros_like(p) for p in model.layers], [np.zeros_like(p) for p in model.layers]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for begin in range(0, len(x), 64):
            step += 1
            pick = order[begin:begin + 64]
            w1, b1, w2, b2 = model.layers
            hidden = np.tanh(x[pick] @ w1 + b1)
            slope = (sigmoid(hidden @ w2 + b2[0]) - y[pick]) / len(pick)
            back = slope[:, None] * w2 * (1 - hidden**2)
            grads = [x[pick].T @ back + 1e-4 * w1, back.sum(axis=0), hidden.T @ slope + 1e-4 * w2, np.array([slope.sum()])]
            for p, g, m, s in zip(model.layers, grads, means, squares):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= 0.003 * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    if apart.any():
        logits, truth = model.logits(features[apart]), labels[apart]
        tries = np.exp(np.linspace(np.log(0.5), np.log(8), 61))
        chances = [np.clip(sigmoid(logits / t), 1e-12, 1 - 1e-12) for t in tries]
        losses = [-np.mean(np.where(truth == 1, np.log(p), np.log(1 - p))) for p in chances]
        losses += np.log(tries) ** 2 / len(truth)  # few rows cannot move it far from 1
        model.temperature = float(tries[int(np.argmin(losses))])
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE,
) -> QualityModel | None:
    """The model fitted on the bounded sample, None without labelled documents."""
    may_learn, _ = learnable_part(id_col)
    bounded_batches(docs.sparkSession)
    draw = F.md5(F.col(id_col).cast("string"))
    picked = (
        labels.where(may_learn & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("s_id"), F.col(label_col).cast("int").alias("label"), draw.alias("draw"))
        .orderBy("draw", "label").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(picked), F.col("id") == F.col("s_id")  # at most ``sample`` rows
    )
    rows = cut_lineage(texts.select("draw", "label", "text").repartition(PARTS, "draw"))
    rows = rows.coalesce(PARTS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros((2 * UNITS, DIM), np.float32)
        for _, texts in portions(batches, 0):
            contexts(texts, index, sums)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    vectors = np.zeros((2 * UNITS, DIM), np.float32)
    # at most PARTS matrices of fixed size, each sum exact in whole numbers
    for (sums,) in rows.select("text").mapInArrow(gather, "sums binary").collect():
        vectors += np.frombuffer(sums, np.float32).reshape(vectors.shape)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, 2):
            found = pooled(texts, vectors)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in found], pa.binary())],
                ["draw", "label", "vector"],
            )

    known = rows.select("draw", "label", "text").mapInArrow(pool, "draw string, label int, vector binary")
    found = sorted((r.draw, r.label, bytes(r.vector)) for r in known.collect())
    if not found:
        return None
    features = np.frombuffer(b"".join(v for _, _, v in found), np.float32).reshape(len(found), DIM).astype(float)
    return train(vectors, features, np.array([label for _, label, _ in found]))


def score_documents(
    docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Rows (id, held_out, score, predicted), one per input row."""
    _, held = learnable_part(id_col)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), held.alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, 2):
            scores = model.scores(texts) if model is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32))],
                [*batch.schema.names[:2], "score", "predicted"],
            )

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(
    docs: DataFrame, model: QualityModel | None, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The input rows that the classifier does not reject, with their columns; all of them without a model."""
    if model is None:
        return docs
    bounded_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in portions(batches, place):
            yield batch.filter(pa.array(model.scores(texts) >= threshold))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))
