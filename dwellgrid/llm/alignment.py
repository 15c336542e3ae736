"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece model (B) over whole documents.

Both tokenizers read space + text (B adds the space itself); the bytes of their tokens cover the same byte string.

1. Tokens. A text is cut before a single space that stands between two characters other than white space. Neither
   tokenizer joins anything across such a place (B's vocabulary is checked for it), so each piece is encoded once per
   task and remembered in a lexicon of bounded size.
2. Overlaps. Per batch, keyed by document, ``pandas.merge_asof`` finds for each start of an A token the B token that
   covers it, and for each start of a B token the A token; the union of both directions is the set of overlapping
   occurrence pairs. Overlaps whose ends agree are links, and they close the groups.
3. Counts. A block of documents (about ``BLOCK_BYTES`` of text) carries its distinct id pairs once, with their number of
   links; the corpus counts are one aggregation over them. Counts return to a block through a join on the id pair, in
   which every pair occurs once per block, and meet the block's documents in one task.

Defined results: null and empty texts and texts whose joined token bytes differ from space + text (a literal U+2581, for
one) have no tokens: all numbers are zero, the group string is empty and its digest ''. Every input row gives one row;
repeated rows count as often as they occur; ids are only carried along. Tables without rows give no rows. Columns beyond
id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.text import bounded_batches, portions
from dwellgrid.session import cut_lineage

BLOCK_BYTES = 1 << 20
LEXICON_BYTES = 40 << 20
SPACE_MARK = "▁"
CUT = re.compile(r"(?<=\S) (?=\S)")
JOINED = 2000  # parts that are encoded in one call
BLOCK_BITS = 32  # blocks of one task
ID_BITS = 20  # ids of either vocabulary


# -- tokenizers -------------------------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, at in vocab.items():
            known = all(c in letters for c in token)
            self.a_bytes[at] = bytes(letters[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.a_lengths, self.b_lengths = (
            np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes)
        )
        self.cuts = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)

    def parts(self, text: str) -> list[str]:
        """Pieces that both tokenizers encode on their own; each stands for a space and itself."""
        if not self.cuts:
            return [text]
        words = text.split()
        plain = len(words) == text.count(" ") + 1 and not text.startswith(" ") and not text.endswith(" ")
        return words if plain and len(text) == sum(map(len, words)) + len(words) - 1 else CUT.split(text)

    def encode(self, parts: list[str]) -> "Encoded":
        """Ids of A and ids of B, each with its sizes per part, and whether both spell space + part."""
        a = flattened([e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)])
        b = flattened(self.b.encode(parts, num_threads=1))
        good = np.ones(len(parts), bool)
        for (ids, counts), spelled in ((a, self.a_bytes), (b, self.b_bytes)):
            names, ends = [spelled[i] for i in ids.tolist()], np.cumsum(counts).tolist()
            good &= [b"".join(names[e - n:e]) == b" " + p.encode() for e, n, p in zip(ends, counts.tolist(), parts)]
        return Encoded(a, b, good)

    def encode_joined(self, parts: list[str]) -> "Encoded":
        """The same for parts that neither start nor end with white space: many in one call, cut at their ends."""
        whole = " ".join(parts)
        want = (" " + whole).encode()
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        sides = []
        for ids, spelled, lengths in (
            (self.a.encode(" " + whole, add_special_tokens=False).ids, self.a_bytes, self.a_lengths),
            (self.b.encode(whole), self.b_bytes, self.b_lengths),
        ):
            ids = np.array(ids, np.int32)
            token_ends = np.cumsum(lengths[ids])
            last = np.minimum(np.searchsorted(token_ends, ends), len(ids) - 1)
            if b"".join([spelled[i] for i in ids.tolist()]) != want or (token_ends[last] != ends).any():
                return self.encode(parts)
            sides.append((ids, np.diff(last, prepend=-1)))
        return Encoded(*sides, np.ones(len(parts), bool))


@dataclass
class Encoded:
    """Ids and sizes per part of both sides, and which parts both sides spell."""

    a: tuple[np.ndarray, np.ndarray]
    b: tuple[np.ndarray, np.ndarray]
    good: np.ndarray


def flattened(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(rows), np.int32), np.fromiter(map(len, rows), np.int64, len(rows))


class Ragged:
    """Rows of whole numbers, appended and gathered in bulk."""

    def __init__(self):
        self.flat = np.empty(0, np.int32)
        self.sizes = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of these rows one after another, size of each row)."""
        sizes = self.sizes[rows]
        shift = self.starts[rows] - (np.cumsum(sizes) - sizes)
        return self.flat[np.arange(sizes.sum()) + np.repeat(shift, sizes)], sizes


class Lexicon:
    """Encoded parts by number; emptied when it holds more than its bound, which changes no result."""

    def __init__(self, tokenizers: Tokenizers, bound: int = LEXICON_BYTES):
        self.tokenizers, self.bound = tokenizers, bound
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.a, self.b = Ragged(), Ragged()
        self.good = np.empty(0, bool)
        self.held = 0

    def number(self, parts: list[str]) -> np.ndarray:
        if self.held > self.bound:
            self.clear()
        new = [p for p in dict.fromkeys(parts) if p not in self.numbers]
        plain = [p for p in new if p == p.strip() and p] if self.tokenizers.cuts else []
        odd = new if not plain else [p for p in new if p != p.strip() or not p]
        found = [self.tokenizers.encode_joined(plain[i:i + JOINED]) for i in range(0, len(plain), JOINED)]
        found += [self.tokenizers.encode(odd)] if odd else []
        if new:
            self.numbers.update(zip(plain + odd, range(len(self.numbers), len(self.numbers) + len(new))))
            self.a.add(*(np.concatenate(x) for x in zip(*(f.a for f in found))))
            self.b.add(*(np.concatenate(x) for x in zip(*(f.b for f in found))))
            self.good = np.concatenate([self.good, *(f.good for f in found)])
            self.held += sum(map(len, new)) + 150 * len(new) + 4 * sum(len(f.a[0]) + len(f.b[0]) for f in found)
        return np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))


# -- alignment of one batch -------------------------------------------------------------------------------------------


def token_frame(name: str, ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
    """Frame (doc, at, number of the token) and the ends: byte offsets run on over the documents of a batch."""
    ends = np.cumsum(lengths[ids])
    return pd.DataFrame({"doc": docs, "at": ends - lengths[ids], name: np.arange(len(ids))}), ends


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence pairs (a, b) that share bytes: the cover of each start, in both directions.

    A pair comes from both directions only if both tokens start at the same byte, so the second direction leaves
    these out."""
    forward = pd.merge_asof(a, b, on="at", by="doc")
    back = pd.merge_asof(b, a, on="at", by="doc")
    cover = back["a"].to_numpy()
    new = a["at"].to_numpy()[cover] != back["at"].to_numpy()
    return (
        np.concatenate((forward["a"].to_numpy(), cover[new])),
        np.concatenate((forward["b"].to_numpy(), back["b"].to_numpy()[new])),
    )


def links_of(a: tuple[pd.DataFrame, np.ndarray], b: tuple[pd.DataFrame, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of each link in order: overlapping pairs that end together."""
    left, right = overlaps(a[0], b[0])
    together = a[1][left] == b[1][right]
    return np.sort(left[together]), np.sort(right[together])  # both orders are the order of the common ends


class Speller:
    """Group strings ``a1,a2|b1;a3|b2`` from ids and links."""

    MARKS = ",|;"

    def __init__(self, ids: int):
        self.names = [f"{i}{m}" for i in range(ids) for m in self.MARKS]

    def codes(self, a_ids: np.ndarray, b_ids: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
        """Ids with the mark that follows each, groups one after another, A before B."""
        a_mark, b_mark = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        a_mark[last_a], b_mark[last_b] = 1, 2
        a_group = np.cumsum(a_mark > 0) - (a_mark > 0)
        b_group = np.cumsum(b_mark > 0) - (b_mark > 0)
        out = np.empty(len(a_ids) + len(b_ids), np.int64)
        b_before = np.concatenate(([0], last_b + 1))
        out[np.arange(len(a_ids)) + b_before[a_group]] = a_ids.astype(np.int64) * 3 + a_mark
        out[np.arange(len(b_ids)) + (last_a + 1)[b_group]] = b_ids.astype(np.int64) * 3 + b_mark
        return out

    def text(self, codes: np.ndarray) -> str:
        return "".join(map(self.names.__getitem__, codes.tolist()))[:-1]


def sums_by_doc(values: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(docs, weights=values, minlength=n).astype(np.int64)


# -- Spark steps ------------------------------------------------------------------------------------------------------

ALIGNED = (
    "n_a long, n_b long, n_groups long, n_links long, groups string, block long, "
    "at array<int>, times array<int>, pairs array<long>, pair_times array<long>"
)
ALIGNED_NAMES = [c.split()[0] for c in ALIGNED.split(", ")]


def aligned_batch(
    texts: list[str], lexicon: Lexicon, speller: Speller, block: int, digest: bool
) -> list[pa.Array]:
    """The columns of ``ALIGNED`` for the documents of one block; the block's id pairs stand in its first row."""
    n = len(texts)
    per_doc = [lexicon.tokenizers.parts(t) if t else [] for t in texts]
    numbers = lexicon.number([p for parts in per_doc for p in parts])
    part_docs = np.repeat(np.arange(n), [len(p) for p in per_doc])
    bad = np.bincount(part_docs[~lexicon.good[numbers]], minlength=n) > 0
    numbers, part_docs = numbers[~bad[part_docs]], part_docs[~bad[part_docs]]
    (a_ids, a_sizes), (b_ids, b_sizes) = lexicon.a.take(numbers), lexicon.b.take(numbers)
    a_docs, b_docs = np.repeat(part_docs, a_sizes), np.repeat(part_docs, b_sizes)
    last_a, last_b = links_of(
        token_frame("a", a_ids, a_docs, lexicon.tokenizers.a_lengths),
        token_frame("b", b_ids, b_docs, lexicon.tokenizers.b_lengths),
    )
    link_docs = a_docs[last_a]
    n_a, n_b, n_links = (np.bincount(d, minlength=n) for d in (a_docs, b_docs, link_docs))
    codes = speller.codes(a_ids, b_ids, last_a, last_b)
    ends = np.cumsum(n_a + n_b)
    groups = []
    for begin, end in zip((ends - n_a - n_b).tolist(), ends.tolist()):
        text = speller.text(codes[begin:end]) if end > begin else ""
        groups.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
    # distinct id pairs of the block, and per document its places among them
    pair = (a_ids[last_a].astype(np.int64) << ID_BITS) | b_ids[last_b]
    pairs, place, pair_times = np.unique(pair, return_inverse=True, return_counts=True)
    held, times = np.unique(link_docs * max(1, len(pairs)) + place, return_counts=True)
    held_docs, at = np.divmod(held, max(1, len(pairs)))
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(held_docs, minlength=n)))), pa.int32())
    first = pa.array([0] + [len(pairs)] * n, pa.int32())  # all in the first row, later rows are empty

    def lists(values: np.ndarray, where: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(where, pa.array(values, kind))

    return [
        pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_links, pa.int64()),
        pa.array(n_links, pa.int64()), pa.array(groups, pa.string()), pa.array(np.full(n, block), pa.int64()),
        lists(at, offsets, pa.int32()), lists(times, offsets, pa.int32()),
        lists(pairs, first, pa.int64()), lists(pair_times, first, pa.int64()),
    ]


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """One row per document with its alignment and its place in a block; written once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(a_path, b_path)
        lexicon, speller = Lexicon(tokenizers), Speller(max(len(tokenizers.a_bytes), len(tokenizers.b_bytes)))
        block = TaskContext.get().partitionId() << BLOCK_BITS
        for batch, texts in portions(batches, 1, BLOCK_BYTES):
            spelled = [t.decode() for t in texts]
            columns = aligned_batch(spelled, lexicon, speller, block, digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *ALIGNED_NAMES])
            block += 1

    kind = rows.schema["id"].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(run, f"id {kind}, {ALIGNED}"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in the corpus, and whether no pair of its B id has more."""
    spread = aligned.where(F.size("pairs") > 0).select(F.explode(F.arrays_zip("pairs", "pair_times")).alias("p"))
    counts = cut_lineage(
        spread.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_times").alias("count"))
        .withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1))
    )
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # one row per id of B
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False
) -> DataFrame:
    """Rows (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one per document.

    ``groups`` spells the groups as ``a1,a2|b1;a3|b2``, or holds the SHA-256 of that string if ``digest`` is set.
    """
    aligned = aligned_blocks(docs, a_path, b_path, id_col, text_col, digest)
    places = aligned.where(F.size("pairs") > 0).select("block", F.posexplode("pairs").alias("place", "pair"))
    known = places.join(pair_counts(aligned), "pair").select(F.col("block").alias("home"), "place", "count", "best")
    own = aligned.drop("pairs", "pair_times")
    kept = ["id", "n_a", "n_b", "n_groups", "n_links"]

    def attach(rows: pa.Table, found: pa.Table) -> pa.Table:
        count = np.zeros(found.num_rows, np.int64)
        best = np.zeros(found.num_rows, np.int64)
        place = found.column("place").to_numpy()
        count[place] = found.column("count").to_numpy()
        best[place] = found.column("best").to_numpy().astype(np.int64)
        at, times = rows.column("at").combine_chunks(), rows.column("times").combine_chunks()
        at, times = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (at, times))
        docs_of = np.repeat(np.arange(rows.num_rows), np.diff(at.offsets.to_numpy()))
        where, often = at.flatten().to_numpy(), times.flatten().to_numpy()
        sums = np.zeros((2, rows.num_rows), np.int64)
        np.add.at(sums[0], docs_of, best[where] * often)
        np.add.at(sums[1], docs_of, count[where] * often)
        out = rows.select(kept).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))
        return out.append_column("groups", rows.column("groups").cast(pa.string()))

    kind = own.schema["id"].dataType.simpleString()
    shape = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    whole = own.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(attach, shape)
    return whole.withColumnRenamed("id", id_col)
