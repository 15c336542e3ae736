"""Substring dedup against a plain count of all windows."""

from collections import Counter

import numpy as np
import pytest

from dwellgrid.llm import substring_dedup as sd
from tests.llm.cases import no_documents, odd_documents, plain, sentence


def brute(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def passages(seed, window):
    """Documents that share passages just below, at and above the window, at every offset, once and often."""
    rng = np.random.default_rng(seed)
    new = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    shared = [new(window + d) for d in (-1, 0, 1, 2 * window)]
    rows = []
    for n in range(90):
        parts = [new(int(rng.integers(0, 2 * window)))]
        for passage in rng.permutation(shared)[: n % 3]:
            parts += [str(passage), new(int(rng.integers(0, 4)))]
        rows.append((n if n % 7 else None, " ".join(parts).strip()))
    rows += [(1000 + n, "one common line " * (n % 30) + shared[1]) for n in range(40)]
    twice = new(window)
    return rows + [(2000, f"{twice}  x\n{twice}"), (2001, "same " * (window + 1)), (2002, "same " * (window - 1)), (2003, "Same " * window)]


@pytest.mark.parametrize("window", [35, 10, 2, 1])
def test_matches_plain_count(spark, window):
    rows = passages(window, window)
    docs = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows], "doc_id long, text string, shard long, range int, home string")
    got = sd.drop_repeats(docs.repartition(5), window=window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert plain(got) == brute(rows, window)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert plain(sd.drop_repeats(docs)) == brute(rows, 35)
    assert sd.drop_repeats(no_documents(spark)).count() == 0


def test_many_ranges_and_portions(spark, monkeypatch):
    monkeypatch.setattr(sd, "RANGE_HASHES", 50)
    monkeypatch.setattr(sd, "LEAST_SHARDS", 7)
    rows = [(i, sentence(i % 4, 300 + i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(sd.drop_repeats(docs)) == brute(rows, 35)


def test_covers_meet_every_difference():
    for period, residues in sd.COVERS.items():
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))
    assert sd.cover_of(35)[0] == 21 and sd.cover_of(1)[0] == 1
    low, high = sd.at_most_twice(np.array([5, 1, 5, 5, 2, 2], np.uint64), np.array([1, 0, 1, 1, 3, 4], np.uint32))
    assert list(zip(low.tolist(), high.tolist())) == [(1, 0), (2, 3), (2, 4), (5, 1), (5, 1)]


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    result = sd.drop_repeats(docs)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 2 or plan.count("REPARTITION_BY_NUM") == 1
