"""BPE encoding and decoding with a contiguous rank array per word.

A word starts as one part per symbol. Two arrays lie side by side: the part boundaries and the merge rank of each pair
of adjacent parts. The encoder scans the ranks for the minimum (leftmost on ties), deletes the boundary between the two
parts and refreshes the two neighbouring ranks, until no pair has a rank. Words of more than ``LONG_WORD`` symbols use
a heap over the same merges instead of the scan, with the same result.

Texts are cut at special token strings, then at white space; the ids of a white-space-free chunk depend on the chunk
alone, so they are kept in a bounded per-process memory (``MEMORY_CHUNKS``); of a full memory
the half that was used longer ago is dropped.

Defined results: a null text is empty and has no tokens; special token strings in a text become their ids; white space
is dropped; every byte has a token, so nothing is unknown. Repeated rows and ids stay as they are.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.text import bounded_batches, portions

LONG_WORD = 64
MEMORY_CHUNKS = 100_000
ID_BITS = 20
ID_MASK = (1 << ID_BITS) - 1
NO_RANK = sys.maxsize
#: Fixed value: the white space of the vocabulary's normaliser, which is dropped.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Newer capital letters, which the vocabulary's library lower-cases and Python 3.13 does not know.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, 0xA7CE: 0xA7CF,
                0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
NEW_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Letters newer than Unicode 16, which the vocabulary's library takes for other signs.
NEWER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959"
    " 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA"
    " 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96"
    " 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E"
    " 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Characters at which str.split() cuts although the normaliser does not.
SPLIT_ONLY = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {b: chr(b) for b in plain}
    for n, byte in enumerate(b for b in range(256) if b not in symbols):
        symbols[byte] = chr(256 + n)
    return [symbols[b] for b in range(256)]


class Memory(dict):
    """Ids by text; when ``MEMORY_CHUNKS`` are reached, what was not used since the last time is dropped."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(self) >= MEMORY_CHUNKS:
            self.older = dict(self)
            self.clear()
        self[key] = ids
        return ids


class BpeCodec:
    """Encoder and decoder of one vocabulary file (BPE with a word-end suffix over byte symbols)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # a pair of ids in one number gives its rank and the id it becomes in one number, which orders by rank
        self.merges = {
            self.vocab[a] << ID_BITS | self.vocab[b]: rank << ID_BITS | self.vocab[a + b]
            for rank, (a, b) in enumerate(model["merges"])
        }
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.names = [names[i].encode() for i in range(len(names))]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.cut = regex.compile(pattern)
        newer = "".join("-".join(f"\\U{int(c, 16):08X}" for c in r.split("-")) for r in NEWER_LETTERS.split())
        self.newer = regex.compile(f"[{newer}]")
        signs = f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{newer}])+"
        self.cut_newer = regex.compile(
            pattern.replace("[^\\s\\p{L}\\p{N}]+", signs).replace("[\\p{L}]+", f"(?:(?![{newer}])\\p{{L}})+")
        )
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.special_mark = re.compile("|".join(sorted({re.escape(s[:2]) for s in self.specials})))
        self.white = re.compile(f"[{WHITE_SPACE}]+")
        symbols = byte_symbols()
        self.inner = [self.vocab[x] for x in symbols]
        self.last = [self.vocab[x + self.suffix] for x in symbols]
        self.chunks, self.words = Memory(self._chunk), Memory(self._word)

    def _word(self, word: str) -> bytes:
        """Ids of one word, packed."""
        parts = self.first_parts(word)
        if len(parts) > LONG_WORD:
            parts = self.merge_long(parts)
        else:
            self.merge_short(parts)
        return struct.pack(f"<{len(parts)}I", *parts)

    def first_parts(self, word: str) -> list[int]:
        """One id per byte, the last with the word end."""
        data = word.encode("utf-8")
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        return parts

    def merge_short(self, parts: list[int]) -> None:
        rank_of = self.merges.get
        ranks = [rank_of(a << ID_BITS | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                return
            i = ranks.index(least)
            parts[i] = least & ID_MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << ID_BITS | parts[i], NO_RANK)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << ID_BITS | parts[i + 1], NO_RANK)

    def merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live: list[int | None] = list(parts)
        heap = [
            (merge, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:]))
            if (merge := self.merges.get(a << ID_BITS | b)) is not None
        ]
        heapq.heapify(heap)
        while heap:
            merge, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] is not None else n
            if j >= n or live[i] != a or live[j] != b:
                continue
            live[i], live[j] = merge & ID_MASK, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n:
                    new = self.merges.get(live[left] << ID_BITS | live[right])
                    if new is not None:
                        heapq.heappush(heap, (new, left, live[left], live[right]))
        return [p for p in live if p is not None]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space or special tokens."""
        if chunk.isascii():
            lowered = chunk.lower()
            if lowered.isalpha():
                return self.words[lowered]
        else:
            lowered = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower().translate(NEW_CAPITALS)
            if self.newer.search(lowered):
                return b"".join([self.words[word] for word in self.cut_newer.findall(lowered)])
        return b"".join([self.words[word] for word in self.cut.findall(lowered)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian unsigned 32-bit integers."""
        if self.special_mark.search(text):
            found = []
            for i, part in enumerate(self.at_special.split(text)):
                found.append(self.specials[part].to_bytes(4, "little") if i % 2 else self._plain(part))
            return b"".join(found)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        chunks = self.white.split(text) if SPLIT_ONLY.search(text) else text.split()
        known = self.chunks
        return b"".join([known[c] for c in chunks if c])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 bytes of the decoded ids: the token strings with spaces between, as this vocabulary has no decoder."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec per process and file."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """Rows (id, ids binary, decoded binary): every text's packed ids and their decoded text, one row per input row.

    ``path`` is the vocabulary file, by default the installed one; executors open it, so it must exist on each.
    """
    file = path or vocabulary_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(file)
        for batch, texts in portions(batches, 1):
            ids = [bpe.encode(text.decode("utf-8", "replace")) for text in texts]
            decoded = [bpe.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                [batch.schema.names[0], "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")




def token_digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256) of the rows of ``encode_documents``."""
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
