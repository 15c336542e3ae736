"""Transaction linking against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dwellgrid.operators import pos

T0 = datetime(2026, 6, 1, 9, 0, 0)
SESSION_SCHEMA = (
    "store_id string, session_id string, visitor_id string, entry_time timestamp, exit_time timestamp, "
    "is_staff boolean, is_converted boolean, zones_visited array<string>"
)


def case(seed: int, n_sessions: int, n_tx: int, span: int, long_share: float):
    rng = random.Random(seed)
    sessions, txs = [], []
    for i in range(n_sessions):
        start = rng.randrange(span)
        kind = rng.random()
        stay = None if kind < 0.2 else rng.randrange(span) if kind < 0.2 + long_share else rng.randrange(400)
        end = None if stay is None else T0 + timedelta(seconds=start + stay)
        store = "S0" if rng.random() < 0.8 else "S1"
        sessions.append((store, f"s{i:03d}", f"v{i}", T0 + timedelta(seconds=start), end, rng.random() < 0.1, False,
                         ["Z_BILLING"] if rng.random() < 0.5 else []))
    for i in range(n_tx):
        store = "S0" if rng.random() < 0.8 else "S1"
        txs.append((f"t{i:03d}", store, 10.0, T0 + timedelta(seconds=rng.randrange(span + 600)), "POS_01"))
    return sessions, txs


def frames(spark, sessions, txs):
    s = spark.createDataFrame(sessions, SESSION_SCHEMA)
    t = spark.createDataFrame(txs, "tx_id string, store_id string, amount double, ts timestamp, pos_terminal_id string")
    return pos.eligible_sessions(s), t


def candidates(sessions, tx):
    return [s for s in sessions if s[0] == tx[1] and not s[5] and s[3] <= tx[3]
            and (s[4] is None or s[4] >= tx[3] - timedelta(seconds=300))]


def serial(sessions, txs):
    taken, links = set(), {}
    for tx in sorted(txs, key=lambda t: (t[3], t[0])):
        free = [s for s in candidates(sessions, tx) if s[1] not in taken]
        if free:
            best = max(free, key=lambda s: (s[3], s[1]))
            taken.add(best[1])
            links[tx[0]] = best[1]
    return links


@pytest.mark.parametrize("seed,shape", [(1, (40, 40, 3000, 0.2)), (2, (60, 30, 2000, 0.6)), (3, (30, 60, 5000, 0.1)),
                                        (4, (80, 80, 1500, 0.0))])
def test_match_equals_serial_order(spark, seed, shape):
    sessions, txs = case(seed, *shape)
    s, t = frames(spark, sessions, txs)
    got = {r.tx_id: r.session_id for r in pos.match_sessions(t, s).collect()}
    assert got == serial(sessions, txs)


def test_match_with_hot_store(tiny_groups):
    sessions, txs = case(5, 40, 40, 2500, 0.3)
    s, t = frames(tiny_groups, sessions, txs)
    got = {r.tx_id: r.session_id for r in pos.match_sessions(t, s).collect()}
    assert got == serial(sessions, txs)


@pytest.mark.parametrize("hot", [False, True])
def test_first_session_and_counts(request, spark, hot):
    if hot:
        request.getfixturevalue("tiny_groups")
    sessions, txs = case(6, 60, 60, 4000, 0.5)
    s, t = frames(spark, sessions, txs)
    first = {r.tx_id: r.session_id for r in pos.first_session(t, s).collect()}
    counts = {r.tx_id: r.n_candidates for r in pos.candidate_counts(t, s).collect()}
    for tx in txs:
        found = candidates(sessions, tx)
        assert counts[tx[0]] == len(found)
        assert first[tx[0]] == (max(found, key=lambda x: (x[3], x[1]))[1] if found else None)


def test_links_feed_events_and_flags(spark):
    sessions, txs = case(7, 20, 20, 1500, 0.3)
    s, t = frames(spark, sessions, txs)
    table = spark.createDataFrame(sessions, SESSION_SCHEMA)
    links = pos.match_sessions(t, s)
    zones = spark.createDataFrame([("S0", "ZB", "BILLING", 0)], "store_id string, zone_id string, zone_type string, zone_ord int")
    events = pos.purchase_events(links, t, table, zones).collect()
    want = serial(sessions, txs)
    assert {(e.session_id, e.zone_id) for e in events} == {
        (sid, "ZB" if next(x for x in sessions if x[1] == sid)[0] == "S0" else "Z_BILLING") for sid in want.values()
    }
    marked = pos.mark_converted(table, links).where("is_converted")
    assert {r.session_id for r in marked.collect()} == set(want.values())
    total = pos.link_counts(t, links).agg(F.sum("linked").alias("l"), F.sum("unlinked").alias("u")).first()
    assert (total.l, total.u) == (len(want), len(txs) - len(want))
