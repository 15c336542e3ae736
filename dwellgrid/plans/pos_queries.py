"""Registered queries: linking transactions to sessions."""

from pyspark.sql import functions as F

from dwellgrid.operators import pos
from dwellgrid.plans import binding as b
from dwellgrid.plans import derived as d
from dwellgrid.plans.binding import EV, TX, uuid5_sql, with_ctes
from dwellgrid.plans.derived import SESS
from dwellgrid.plans.registry import query

CAND = f"""es AS (SELECT {uuid5_sql('session_name')} AS session_id, session_name, store_id, visitor_id, entry_time, exit_time
  FROM sess WHERE NOT is_staff),
cand AS (SELECT t.tx_id, t.store_id, t.ts, e.session_id, e.entry_time FROM tx t LEFT JOIN es e ON e.store_id = t.store_id
  AND e.entry_time <= t.ts AND (e.exit_time IS NULL OR e.exit_time >= t.ts - INTERVAL 300 SECOND))"""


SERIAL = """txn AS MATERIALIZED (SELECT tx_id, store_id, ts, row_number() OVER (PARTITION BY store_id ORDER BY ts, tx_id) AS n FROM tx),
opts AS MATERIALIZED (SELECT c.store_id, t.n, c.tx_id, c.session_id, c.entry_time FROM cand c JOIN txn t USING (tx_id) WHERE c.session_id IS NOT NULL),
mt AS (SELECT store_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS tx_id, CAST(NULL AS VARCHAR) AS session_id
    FROM (SELECT DISTINCT store_id FROM txn)
  UNION ALL SELECT store_id, n + 1, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, tx_id, pick FROM (
    SELECT m.store_id, m.n, any_value(m.taken) AS taken, any_value(t.tx_id) AS tx_id,
      arg_max(o.session_id, (o.entry_time, o.session_id)) FILTER (o.session_id IS NOT NULL AND NOT list_contains(m.taken, o.session_id)) AS pick
    FROM mt m JOIN txn t ON t.store_id = m.store_id AND t.n = m.n + 1 LEFT JOIN opts o ON o.store_id = t.store_id AND o.n = t.n
    GROUP BY m.store_id, m.n)),
lk AS (SELECT store_id, tx_id, session_id FROM mt WHERE session_id IS NOT NULL)"""
MATCH = (EV, TX, SESS.replace("sess AS (", "sess AS MATERIALIZED (", 1), CAND.replace("es AS (", "es AS MATERIALIZED (", 1), SERIAL)


def rec(body: str, *ctes: str) -> str:
    return with_ctes(body, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def unlinked_sessions(spark, sf):
    """Sessions before any linking."""
    return d.session_table(spark, sf).withColumn("is_converted", F.lit(False))


def eligible(spark, sf):
    return pos.eligible_sessions(unlinked_sessions(spark, sf))


@query("tx_session_candidates", with_ctes(
    "SELECT tx_id, store_id, count(session_id) AS n_candidates FROM cand GROUP BY 1, 2", EV, TX, SESS, CAND))
def _(spark, sf):
    return pos.candidate_counts(b.transactions(spark, sf), eligible(spark, sf))


@query("tx_first_session", with_ctes("""SELECT tx_id, store_id, arg_max(session_id, (entry_time, session_id)) AS session_id
  FROM cand GROUP BY 1, 2""", EV, TX, SESS, CAND))
def _(spark, sf):
    return pos.first_session(b.transactions(spark, sf), eligible(spark, sf))


def links(spark, sf):
    return pos.match_sessions(b.transactions(spark, sf), eligible(spark, sf))


@query("tx_session_match", rec("SELECT store_id, tx_id, session_id FROM lk", *MATCH))
def _(spark, sf):
    return links(spark, sf)


@query("purchase_synthesis", rec(f"""SELECT {uuid5_sql("'purchase:' || tx_id")} AS event_id, lk.store_id, session_id, visitor_id, 'PURCHASE' AS event_type,
  txn.ts, 'Z_BILLING' AS zone_id, CAST(1 AS DOUBLE) AS confidence, false AS is_staff, 'CAM_03' AS camera_id
  FROM lk JOIN txn USING (tx_id) JOIN es USING (session_id)""", *MATCH))
def _(spark, sf):
    return pos.purchase_events(links(spark, sf), b.transactions(spark, sf), d.session_table(spark, sf), b.zones(spark, sf))


@query("link_counts", rec("""SELECT store_id, count(lk.session_id) AS linked, count(*) - count(lk.session_id) AS unlinked
  FROM txn LEFT JOIN lk USING (store_id, tx_id) GROUP BY 1""", *MATCH))
def _(spark, sf):
    return pos.link_counts(b.transactions(spark, sf), links(spark, sf))


@query("update_mark_converted", rec(f"""SELECT {uuid5_sql('session_name')} AS session_id, s.store_id, s.visitor_id, s.entry_time,
  {uuid5_sql('session_name')} IN (SELECT session_id FROM lk) AS is_converted FROM sess s""", *MATCH))
def _(spark, sf):
    return pos.mark_converted(unlinked_sessions(spark, sf), links(spark, sf)).select(
        "session_id", "store_id", "visitor_id", "entry_time", "is_converted")


@query("tx_asof_session", with_ctes("""SELECT tx_id, store_id, session_id, lag_seconds, coalesce(lag_seconds <= 300, false) AS within_window
  FROM (SELECT t.tx_id, t.store_id, e.session_id, (epoch_us(t.ts) - epoch_us(e.entry_time)) / CAST(1e6 AS DOUBLE) AS lag_seconds
  FROM tx t ASOF LEFT JOIN es e ON t.store_id = e.store_id AND t.ts >= e.entry_time)""", EV, TX, SESS, CAND))
def _(spark, sf):
    return pos.asof_session(b.transactions(spark, sf), eligible(spark, sf))


@query("billing_sessions_only", with_ctes("""SELECT t.tx_id, t.store_id, count(e.session_id) AS n_candidates FROM tx t
  LEFT JOIN (SELECT * FROM es WHERE session_name IN (SELECT session_name FROM ev WHERE zone_id = 'Z_BILLING')) e
  ON e.store_id = t.store_id AND e.entry_time <= t.ts AND (e.exit_time IS NULL OR e.exit_time >= t.ts - INTERVAL 300 SECOND)
  GROUP BY 1, 2""", EV, TX, SESS, CAND))
def _(spark, sf):
    sessions = pos.eligible_sessions(unlinked_sessions(spark, sf), billing_only="Z_BILLING")
    return pos.candidate_counts(b.transactions(spark, sf), sessions)
