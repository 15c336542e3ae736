"""Linking point-of-sale transactions to visitor sessions.

A session can take a transaction from its entry until the window after its exit; a session without an
exit stays open. All lookups are sweeps over time-ordered rows, so the number of rows handled never
grows with the number of (transaction, session) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.config import PosConfig
from dwellgrid.functions.hashing import uuid5
from dwellgrid.operators.ordered import OrderedRows
from dwellgrid.session import broadcast_if_small, cut_lineage

LEVELS = 31  # dyadic levels: 2**31 buckets of five minutes


def eligible_sessions(sessions: DataFrame, cfg: PosConfig = PosConfig(), billing_only: str | None = None) -> DataFrame:
    """Customer sessions not converted yet, with their interval in microseconds (end null while open)."""
    rows = sessions.where(~F.col("is_staff") & ~F.col("is_converted"))
    if billing_only is not None:
        rows = rows.where(F.array_contains("zones_visited", billing_only))
    end = F.unix_micros("exit_time") + cfg.window_seconds * 1_000_000
    return rows.select("store_id", "session_id", F.unix_micros("entry_time").alias("start_us"), end.alias("end_us"))


def _tx(transactions: DataFrame) -> DataFrame:
    return transactions.select("store_id", "tx_id", F.unix_micros("ts").alias("us"))


def candidate_counts(transactions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Number of candidate sessions per transaction: sessions begun minus sessions ended so far."""
    begins = sessions.select("store_id", F.col("start_us").alias("us"), F.lit(0).alias("kind"), F.col("session_id").alias("id"), F.lit(1).alias("delta"))
    ends = sessions.where(F.col("end_us").isNotNull()).select(
        "store_id", F.col("end_us").alias("us"), F.lit(2).alias("kind"), F.col("session_id").alias("id"), F.lit(-1).alias("delta")
    )
    sales = _tx(transactions).select("store_id", "us", F.lit(1).alias("kind"), F.col("tx_id").alias("id"), F.lit(0).alias("delta"))
    moves = begins.unionByName(ends).unionByName(sales)
    swept = OrderedRows.of(cut_lineage(moves), ["store_id"], ["us", "kind", "id"]).running_sum("live", F.col("delta")).result()
    return swept.where(F.col("kind") == 1).select(
        F.col("id").alias("tx_id"), "store_id", F.col("live").cast("long").alias("n_candidates")
    )


def _latest(col: str = "start_us") -> Column:
    return F.struct(F.col(col).alias("start_us"), F.col("session_id"))


def _dyadic(first: Column, last: Column) -> Column:
    """The few aligned blocks (level, index) that together cover buckets first..last."""
    def at_level(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        lo, hi = F.ceil(first / size), F.floor((last + 1) / size)
        left = F.when((lo < hi) & (lo % 2 == 1), F.struct(k.alias("level"), lo.alias("idx")))
        right = F.when((lo < hi) & (hi % 2 == 1), F.struct(k.alias("level"), (hi - 1).alias("idx")))
        return F.array(left, right)

    return F.array_distinct(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), at_level))))


def first_session(transactions: DataFrame, sessions: DataFrame, cfg: PosConfig = PosConfig()) -> DataFrame:
    """Candidate with the latest entry (then the largest id) per transaction; null when there is none.

    Time is cut into buckets as long as the conversion window, so no session begins and ends in one
    bucket. A candidate of a transaction then either began earlier in its bucket, or ends later in its
    bucket, or covers the whole bucket, or is still open from an earlier bucket.
    """
    width = cfg.window_seconds * 1_000_000
    ses = cut_lineage(sessions.select(
        "*", F.floor(F.col("start_us") / width).alias("b0"), F.floor(F.col("end_us") / width).alias("b1")
    ))
    tx = cut_lineage(_tx(transactions).withColumn("bucket", F.floor(F.col("us") / width)).withColumn("rev", -F.col("us")))
    keys = ["store_id", "bucket"]
    none = F.lit(None).cast("struct<start_us:bigint,session_id:string>")

    def sweep(rows: DataFrame, out: str) -> DataFrame:
        sales = tx.select(*keys, F.col("us" if out == "began" else "rev").alias("at"), F.lit(1).alias("kind"), F.col("tx_id").alias("id"), none.alias("cand"))
        swept = OrderedRows.of(rows.unionByName(sales), keys, ["at", "kind", "id"]).running_max(out, F.col("cand")).result()
        return swept.where(F.col("kind") == 1).select(F.col("id").alias("tx_id"), out)

    began = sweep(ses.select("store_id", F.col("b0").alias("bucket"), F.col("start_us").alias("at"), F.lit(0).alias("kind"), F.col("session_id").alias("id"), _latest().alias("cand")), "began")
    ending = sweep(
        ses.where(F.col("end_us").isNotNull())
        .select("store_id", F.col("b1").alias("bucket"), (-F.col("end_us")).alias("at"), F.lit(0).alias("kind"), F.col("session_id").alias("id"), _latest().alias("cand")),
        "ending",
    )

    covered = (
        ses.where(F.col("b1") - F.col("b0") >= 2)
        .select("store_id", _latest().alias("cand"), F.inline(_dyadic(F.col("b0") + 1, F.col("b1") - 1)))
        .groupBy("store_id", "level", "idx").agg(F.max("cand").alias("cand"))
    )
    buckets = tx.select(*keys).distinct()
    levels = buckets.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    over = (
        levels.withColumn("idx", F.floor(F.col("bucket") / F.pow(F.lit(2.0), F.col("level"))))
        .join(covered, ["store_id", "level", "idx"]).groupBy(*keys).agg(F.max("cand").alias("covering"))
    )
    still_open = ses.where(F.col("end_us").isNull()).groupBy("store_id", F.col("b0").alias("bucket")).agg(F.max(_latest()).alias("o"))
    w = Window.partitionBy("store_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    marks = buckets.join(still_open, keys, "full")  # one row per store and bucket: bounded by the calendar
    earlier = marks.select(*keys, F.max("o").over(w).alias("open"))

    joined = (
        tx.join(began, "tx_id", "left").join(ending, "tx_id", "left").join(over, keys, "left").join(earlier, keys, "left")
    )
    best = F.greatest("began", "ending", "covering", "open")
    return joined.select("tx_id", "store_id", best["session_id"].alias("session_id"))


def match_sessions(transactions: DataFrame, sessions: DataFrame) -> DataFrame:
    """One-to-one links: in time order every transaction takes its latest free candidate session.

    Without ends this is bracket matching, which needs only running depths: a transaction pairs with the
    previous row of its depth. Each round pairs the remaining rows this way, keeps the pairs that respect
    the session's end and enclose no pair that breaks it, drops the sessions of the innermost broken pairs
    (they ended before every later transaction) and repeats with what is left. A round without broken
    pairs is the last one; the sessions dropped guarantee progress, and no round limit is needed.
    """
    order = ["us", "kind", "id"]
    begins = sessions.select("store_id", F.col("start_us").alias("us"), F.lit(0).alias("kind"), F.col("session_id").alias("id"), "end_us")
    sales = _tx(transactions).select("store_id", "us", F.lit(1).alias("kind"), F.col("tx_id").alias("id"), F.lit(None).cast("long").alias("end_us"))
    left, links = cut_lineage(begins.unionByName(sales)), None
    measured = None
    while True:
        is_tx = F.col("kind") == 1
        rows = OrderedRows.of(left, ["store_id"], order, inside=measured)
        measured = measured or rows
        useful = rows.next_value("next_tx", F.when(is_tx, F.col("us"))).where(
            is_tx | (F.col("next_tx") <= F.coalesce(F.col("end_us"), F.col("next_tx")))
        )
        deep = useful.running_sum("after", F.when(is_tx, -1).otherwise(1)).result()
        level = F.when(is_tx, F.col("after") + 1).otherwise(F.col("after"))
        paired = (
            OrderedRows.of(deep.withColumn("level", level).drop("after", "next_tx"), ["store_id", "level"], order, inside=measured)
            .lag({"s_id": "id", "s_end": "end_us", "s_kind": "kind"}).result()
        )
        mate = is_tx & (F.col("s_kind") == 0)
        broken = F.coalesce(mate & (F.col("us") > F.col("s_end")), F.lit(False))
        counted = (
            OrderedRows.of(paired.withColumn("mate", mate).withColumn("broken", broken), ["store_id"], order, inside=measured)
            .running_sum("bad", F.col("broken").cast("int")).result()
        )
        state = cut_lineage(
            OrderedRows.of(counted, ["store_id", "level"], order, inside=measured).lag({"s_bad": "bad"}).result()
            .withColumn("inner_bad", F.col("bad") - F.col("s_bad") - F.col("broken").cast("int"))
        )
        good = F.col("mate") & ~F.col("broken") & (F.col("inner_bad") == 0)
        found = state.where(good).select("store_id", F.col("id").alias("tx_id"), F.col("s_id").alias("session_id"))
        links = found if links is None else links.unionByName(found)
        if state.where("broken").isEmpty():
            return links
        gone = state.where(F.col("mate") & (F.col("inner_bad") == 0)).select("store_id", F.col("s_id").alias("id"), F.lit(0).alias("kind"))
        done = state.where(F.coalesce(good, F.lit(False)) | (is_tx & ~F.coalesce(F.col("mate"), F.lit(False)))).select("store_id", "id", F.lit(1).alias("kind"))
        left = cut_lineage(
            state.select("store_id", *order, "end_us").join(gone.unionByName(done), ["store_id", "id", "kind"], "left_anti")
        )


def mark_converted(sessions: DataFrame, links: DataFrame) -> DataFrame:
    linked = links.select("session_id", F.lit(True).alias("_linked")).dropDuplicates(["session_id"])
    return sessions.join(linked, "session_id", "left").withColumn(
        "is_converted", F.coalesce("_linked", "is_converted")
    ).drop("_linked")


def purchase_events(
    links: DataFrame, transactions: DataFrame, sessions: DataFrame, zones: DataFrame, cfg: PosConfig = PosConfig()
) -> DataFrame:
    """One PURCHASE event per linked transaction, with an id derived from the transaction's."""
    billing = zones.where(F.col("zone_type") == "BILLING").groupBy("store_id").agg(
        F.min_by("zone_id", "zone_ord").alias("billing_zone")
    )
    rows = links.join(transactions.select("tx_id", "ts"), "tx_id").join(
        sessions.select("session_id", "visitor_id"), "session_id"
    ).join(broadcast_if_small(billing), "store_id", "left")
    return rows.select(
        uuid5(F.concat(F.lit("purchase:"), F.col("tx_id"))).alias("event_id"), "store_id", "session_id", "visitor_id",
        F.lit("PURCHASE").alias("event_type"), "ts",
        F.coalesce("billing_zone", F.lit(cfg.fallback_billing_zone)).alias("zone_id"),
        F.lit(1.0).alias("confidence"), F.lit(False).alias("is_staff"), F.lit(cfg.purchase_camera).alias("camera_id"),
    )


def link_counts(transactions: DataFrame, links: DataFrame) -> DataFrame:
    marked = transactions.select("store_id", "tx_id").join(links.select("tx_id", F.lit(1).alias("_l")), "tx_id", "left")
    return marked.groupBy("store_id").agg(F.count("_l").alias("linked"), (F.count("*") - F.count("_l")).alias("unlinked"))


def asof_session(transactions: DataFrame, sessions: DataFrame, cfg: PosConfig = PosConfig()) -> DataFrame:
    """Nearest session begun at or before each transaction, and whether it began within the window."""
    none = F.lit(None).cast("struct<start_us:bigint,session_id:string>")
    begins = sessions.select("store_id", F.col("start_us").alias("us"), F.lit(0).alias("kind"), F.col("session_id").alias("id"), _latest().alias("s"))
    sales = _tx(transactions).select("store_id", "us", F.lit(1).alias("kind"), F.col("tx_id").alias("id"), none.alias("s"))
    moves = cut_lineage(begins.unionByName(sales))
    swept = OrderedRows.of(moves, ["store_id"], ["us", "kind", "id"]).last_value("last", F.col("s")).result()
    lag = (F.col("us") - F.col("last.start_us")) / 1e6
    return swept.where(F.col("kind") == 1).select(
        F.col("id").alias("tx_id"), "store_id", F.col("last.session_id").alias("session_id"),
        lag.alias("lag_seconds"), F.coalesce(lag <= cfg.window_seconds, F.lit(False)).alias("within_window"),
    )
