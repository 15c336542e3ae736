"""Cross-tokenizer alignment against a plain walk over whole texts and counts in one dictionary."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from dwellgrid.llm import alignment, bpe
from tests.llm.cases import no_documents, odd_documents, plain

A, B = bpe.vocabulary_path("byte_bpe_50k.json"), bpe.vocabulary_path("piece_bpe_32k.model")


def whole_tokens(texts):
    """Per text the (id, end) lists of both sides, encoded whole, or None."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    letters = alignment.byte_alphabet()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        want = (" " + text).encode()
        if b"".join(x for _, x in left) != want or b"".join(x for _, x in right) != want:
            out.append(None)
            continue
        sides = []
        for side in (left, right):
            at, ends = 0, []
            for i, data in side:
                at += len(data)
                ends.append((i, at))
            sides.append(ends)
        out.append(sides)
    return out


def brute(rows):
    tokens = whole_tokens([t for _, t in rows])
    links, groups = [], []
    for pair in tokens:
        if pair is None:
            links.append([])
            groups.append("")
            continue
        a, b = pair
        b_ends = {end: i for i, end in b}
        links.append([(i, b_ends[end]) for i, end in a if end in b_ends])
        held = {cut: ([], []) for cut in sorted({end for _, end in a} & set(b_ends))}
        for side, place in ((a, 0), (b, 1)):
            cuts = iter(held)
            cut = next(cuts)
            for i, end in side:
                while end > cut:
                    cut = next(cuts)
                held[cut][place].append(str(i))
        groups.append(";".join(",".join(x) + "|" + ",".join(y) for x, y in held.values()))
    counts = Counter(p for found in links for p in found)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted(
        ((doc_id, *((len(t[0]), len(t[1])) if t else (0, 0)), len(found), len(found),
          sum(counts[p] == highest[p[1]] for p in found), sum(counts[p] for p in found), text)
         for (doc_id, _), t, found, text in zip(rows, tokens, links, groups)), key=repr)


ODD = [
    "plain words here", " leading", "two  spaces", "tab\tand\r\nlines \n", "ﬁ ligature é東京 ☃ 😀", "▁ mark", "a ▁b", "<s> </s> <unk> <0x41>",
    "<|endoftext|> text", "nul\x00 byte", " a  b  c", "x" * 3000, "it's we'll I'd 's", "1 2 345 67890", "...!!! ?", " ", "  ", "\n",
    "\x1f a \x85 b", "a​b ​ c", "ÀÉ Straße naïve", "é à b",
]


def test_matches_plain_walk(spark):
    rows = [(i if i % 6 else None, t) for i, t in enumerate(ODD)] + [(3, "plain words here"), (3, "plain words here")]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, id string, block int, groups int")
    got = plain(alignment.align_documents(docs.repartition(3), A, B))
    assert got == brute(rows)


def test_odd_documents_and_digests(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute(rows)]
    got = alignment.align_documents(docs, A, B, digest=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert plain(got) == sorted(want, key=repr)
    assert alignment.align_documents(no_documents(spark), A, B).count() == 0


def test_small_blocks_and_lexicon(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 64)
    lexicon = alignment.Lexicon(alignment.Tokenizers(A, B), bound=1)
    first = lexicon.number(["a", "b", "a"])
    assert first.tolist() == [0, 1, 0] and lexicon.number(["c"]).tolist() == [0]
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert plain(alignment.align_documents(docs, A, B)) == brute(rows)


@pytest.mark.parametrize("seed", range(5))
def test_overlaps_are_all_shared_bytes(seed):
    rng = np.random.default_rng(seed)
    frames = []
    for name in "ab":
        ids, docs, lengths = [], [], []
        for doc, size in enumerate((7, 1, 20)):
            cuts = np.unique(np.concatenate((rng.integers(1, size + 1, 6), [size])))
            lengths += np.diff(np.concatenate(([0], cuts))).tolist()
            docs += [doc] * len(cuts)
        frames.append(alignment.token_frame(name, np.arange(len(lengths)), np.array(docs), np.array(lengths)))
    (a, a_ends), (b, b_ends) = frames
    got = sorted(zip(*(side.tolist() for side in alignment.overlaps(a, b))))
    want = [(i, j) for i in a["a"] for j in b["b"] if a["at"][i] < b_ends[j] and b["at"][j] < a_ends[i]]
    assert got == sorted(want)
