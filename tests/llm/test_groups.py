"""Exact and near dedup, sharding and mixing against plain re-implementations."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellgrid.llm import exact_dedup, mixing, near_dedup, sharding
from tests.llm.cases import no_documents, odd_documents, plain, sentence


def last_none(i):
    return (i is None, i or 0)


@pytest.mark.parametrize("counters", [256, 3])
def test_exact_copies(spark, counters):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0D]", "", t)].append((-len(t), last_none(i), i))
    want = []
    for key, members in groups.items():
        sha = hashlib.sha256(key.encode()).hexdigest()
        for place, (_, _, i) in enumerate(sorted(members, key=lambda m: m[:2])):
            want.append((i, min(members, key=lambda m: m[:2])[2], len(members), place == 0, sha))
    assert plain(exact_dedup.mark_copies(docs, counters=counters)) == sorted(want, key=repr)
    kept = exact_dedup.drop_copies(docs, counters=counters)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.mark_copies(no_documents(spark)).count() == exact_dedup.drop_copies(no_documents(spark)).count() == 0


def test_heavy_text_is_settled_without_its_rows_meeting(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    rows = exact_dedup.digest_rows(docs, "doc_id", "text")
    assert exact_dedup.heavy_winners(rows).select("group_size").collect() == [(1000,)]
    marked = exact_dedup.mark_copies(docs)
    assert marked.where("group_size = 1000 and keep_id = 0").count() == 1000 and marked.where("kept").count() == 2001


def test_misra_gries_keeps_frequent_keys():
    counts = {"a": 50, **{str(i): 1 for i in range(60)}}
    assert exact_dedup.misra_gries(counts, 10) == {"a": 49}


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), doc_id), doc_id, key=last_none)
    return [(d, len(sets[i]), low[root(i)] if sets[i] else d, d == low[root(i)] if sets[i] else True) for i, (d, _) in enumerate(rows)]


def test_near_copies_of_odd_documents(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert plain(near_dedup.near_duplicates(docs)) == sorted(brute_components(rows), key=repr)
    kept = near_dedup.keep_first_of_each(docs)
    with_words = {c for d, n, c, k in brute_components(rows) if n}
    wordless = sum(1 for _, n, _, _ in brute_components(rows) if not n)
    assert kept.columns == docs.columns and kept.count() == len(with_words) + wordless
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("block", [512, 4])
def test_chains_and_large_groups_of_near_copies(spark, monkeypatch, block):
    """A chain whose ends differ, and variants of one text at and around the threshold, some of them only linked by others."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, words = [], [f"w{i}" for i in range(140)]
    for i in range(30):
        words[(i * 5) % 140] = f"c{i}"
        rows.append((1000 - i, " ".join(words)))
    base = [f"b{i}" for i in range(120)]
    for i in range(60):
        variant = list(base)
        for at in rng.choice(120, size=int(rng.integers(1, 5)), replace=False):
            variant[at] = f"v{i}-{at}"
        rows.append((i, " ".join(variant)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(near_dedup.near_duplicates(docs)) == sorted(brute_components(rows), key=repr)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    parts = near_dedup.sketches(np.concatenate([a[:500], a[300:], a]), np.array([500, 600, 900]))
    assert (np.maximum(parts[0], parts[1]) == parts[2]).all()
    assert abs((parts[0] == parts[2]).mean() - 500 / 900) < 0.15
    assert (near_dedup.sketches(np.empty(0, np.uint64), np.array([0, 0])) == 0).all()
    one = near_dedup.sketches(a[:1], np.array([1]))
    assert (one > 0).all()


@pytest.mark.parametrize("copies", [0, 700])
def test_shards_are_balanced_and_gapless(spark, copies):
    docs = odd_documents(spark).select("doc_id", "text").where("length(text) < 2000 or text is null")
    more = [(100 + i, sentence(i, 20 + i % 50)) for i in range(900)] + [(2000 + i, sentence(5, 30)) for i in range(copies)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sharding.pack_documents(docs).collect()
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(want, key=repr)
    shards = collections.defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        shards[r.shard].append(r)
    loads = [sum(r.size for r in rows) for rows in shards.values()]
    assert sorted(shards) == list(range(16)) and max(loads) - min(loads) <= 0.03 * max(loads)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())
    if not copies:  # copies stay together unless their group is split
        homes = collections.defaultdict(set)
        for r in got:
            homes[r.text_crc32].add(r.shard)
        assert max(map(len, homes.values())) == 1
    assert sorted(map(tuple, got), key=repr) == plain(sharding.pack_documents(docs.repartition(5)))
    assert sharding.pack_documents(no_documents(spark)).count() == 0


def water_level(sizes, weights, passes=3):
    target, open_, left = {}, dict(zip(sizes, weights)), float(sum(sizes.values()))
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * level > passes * sizes[s]]
        if not full:
            return target | {s: w * level for s, w in open_.items()}
        for s in full:
            target[s] = float(passes * sizes[s])
            left -= target[s]
            del open_[s]
    return target


def assert_mixed_as_planned(mix, plan, docs):
    """Whole input rows only; each source gives its planned words but for half a document."""
    inputs = {tuple(r) for r in docs.collect()}
    found = [tuple(r) for r in mix.collect()]
    assert set(found) <= inputs
    at = docs.columns.index("source"), docs.columns.index("text")
    words, planned, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for row in found:
        words[row[at[0]]] += len(row[at[1]].encode().split())
    for r in plan:
        planned[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(words[s] - planned[s]) <= largest[s] / 2 for s in planned)


@pytest.mark.parametrize("ids", ["none", "few", "own"])
def test_mix_takes_what_it_plans(spark, ids):
    of = {"none": lambda i: None, "few": lambda i: i % 3, "own": lambda i: i}[ids]
    rows = [(of(i), f"{i} " + "word " * 9, "abc"[0 if i < 100 else 1 if i < 300 else 2]) for i in range(500)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    assert_mixed_as_planned(mixing.mixed_documents(docs), mixing.fair_queue(docs).collect(), docs)


def test_mix_meets_its_targets(spark):
    rows = [(i if i % 11 else None, sentence(i, 1 + (i * i) % 90) if i % 13 else None,
             None if i % 17 == 0 else ["tiny", "big", "mid", "Upper", "é"][0 if i % 40 == 0 else 1 + i % 4]) for i in range(400)]
    rows += [(5, "again and again", "dup")] * 3
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 1) for r in rows], "doc_id long, text string, source string, n_chars long, draw string, size int")
    got = mixing.fair_queue(docs).collect()
    size_of = collections.Counter()
    for _, t, s in rows:
        size_of[s] += len((t or "").encode().split())
    order = sorted((s for s in size_of if s is not None)) + [None]
    targets = water_level({s: size_of[s] for s in order}, [(5, 2, 1)[i % 3] for i in range(len(order))])
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size_of[r.source] and abs(r.target - targets[r.source]) < 1e-6 * (1 + r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - targets[s]) <= 1 for s in order)
    columns = ["doc_id", "source", "size", "taken", "finish"]
    assert plain(mixing.fair_queue(docs.repartition(7)).select(columns)) == plain(mixing.fair_queue(docs).select(columns))
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    assert_mixed_as_planned(mix, got, docs)
    assert mixing.fair_queue(no_documents(spark)).count() == mixing.mixed_documents(no_documents(spark)).count() == 0


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark)
    assert mixing.fair_queue(docs).count() == docs.count()
    assert mixing.mixed_documents(docs).columns == docs.columns
    empty = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r.target, r.taken) for r in mixing.fair_queue(empty).collect()} == {(0.0, 0)}


@pytest.mark.parametrize("per_task", [500_000, 7])
def test_components_of_chains_and_stars(spark, monkeypatch, per_task):
    monkeypatch.setattr(near_dedup, "LINKS_PER_TASK", per_task)
    node = lambda i: hashlib.md5(str(i).encode()).digest()
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300), (203, 202), (202, 200)]
    rows = spark.createDataFrame([(node(a), node(b)) for a, b in links], "a binary, b binary").repartition(6)
    groups = [list(range(41)), list(range(100, 130)), [200, 201, 202, 203]]
    want = {node(i): min(map(node, g)) for g in groups for i in g}
    assert {bytes(r.node): bytes(r.root) for r in near_dedup.components(rows).collect()} == want
    assert near_dedup.components(rows.limit(0)).count() == 0
