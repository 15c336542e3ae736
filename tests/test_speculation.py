"""Folds whose state never forgets: few rounds, and a crowded key in one."""

import pytest
from pyspark.sql import functions as F

from dwellgrid.operators import speculation

KEYS, STATE = ["key"], "struct<total:long>"


def running_total(state):
    """Needs every row before it, so no chunk is right until its predecessor is."""
    total = state[0]["total"] if state else 0

    def take(row):
        nonlocal total
        total += row["value"]
        return row["at"], total

    return take, lambda: [{"total": total}]


@pytest.mark.parametrize("per_slot, chunks", [(2, 48), (5000, 1)])
def test_a_chain_through_all_chunks_takes_few_rounds(spark, monkeypatch, per_slot, chunks):
    staged, cut = [], speculation.cut_lineage

    def counted(df):
        staged.append(df.columns)
        return cut(df)

    monkeypatch.setattr(speculation, "cut_lineage", counted)
    rows = spark.range(48 * per_slot).select(
        (F.col("id") % 2).alias("key"), F.floor(F.col("id") / (2 * per_slot) * 2).alias("at"), (F.col("id") % 7).alias("value"))
    numbered = rows.withColumn("at", F.expr("row_number() over (partition by key order by at, value)"))
    cutup = speculation.in_chunks(numbered, KEYS, "at", per_slot // 2 or 1, 1) if chunks > 1 else speculation.in_chunks(
        numbered, KEYS, "at", 5000, 1)
    assert cutup.agg(F.max("chunk")).first()[0] == chunks
    out = speculation.fold_in_rounds(
        cutup, KEYS, ["at", "value"], running_total, "at long, total long", STATE, "at", lambda entry, time: F.lit(True))
    want = {(r.key, r.at): r.s for r in numbered.selectExpr("key", "at", "sum(value) over (partition by key order by at, value) s").collect()}
    assert {(r.key, r.at): r.total for r in out.collect()} == want
    assert len([c for c in staged if "moved" in c]) <= 8  # comparisons of starts, one a round


def test_a_fold_of_many_rows_takes_chunks_as_lists(spark):
    """A fold of lists of rows gives what single rows give."""
    def totals(state):
        take, end = running_total(state)
        return lambda found: [take(row) for row in found], end

    rows = spark.range(4000).select((F.col("id") % 2).alias("key"), F.floor(F.col("id") / 2).alias("at"), (F.col("id") % 7).alias("value"))
    for chunk_rows in (1, 700):
        out = speculation.fold_in_rounds(
            speculation.in_chunks(rows, KEYS, "at", 100, chunk_rows), KEYS, ["at", "value"], totals,
            "at long, total long", STATE, "at", lambda entry, time: F.lit(True), many=True)
        want = {(r.key, r.at): r.s for r in rows.selectExpr("key", "at", "sum(value) over (partition by key order by at, value) s").collect()}
        assert {(r.key, r.at): r.total for r in out.collect()} == want
