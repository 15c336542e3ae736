"""Chunked computations equal plain windows for any split of a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from dwellgrid.operators.ordered import OrderedRows


def data(spark, seed):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", rng.randrange(50), i,
             rng.choice([None, rng.randrange(-5, 9)])) for i in range(120)]
    return spark.createDataFrame(rows, "k string, t int, id int, v int")


def compute(df):
    rows = OrderedRows.of(df, ["k"], ["t", "id"])
    out = (
        rows.running_sum("total", F.coalesce("v", F.lit(0))).row_number("n").running_max("top", F.col("v"))
        .last_value("seen", F.col("v")).next_value("coming", F.col("v"))
        .lag({"pv": "v", "pid": "id"}).lead({"nv": "v", "nid": "id"})
    )
    return rows.chunked, sorted(tuple(r) for r in out.result().select("k", "t", "id", "total", "n", "top", "seen", "coming", "pv", "pid", "nv", "nid").na.fill(-99).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunked_equals_plain(spark, seed):
    df = data(spark, seed)
    plain_chunked, plain = compute(df)
    spark.conf.set("dwellgrid.maxGroupRows", "7")
    try:
        was_chunked, spread = compute(df)
    finally:
        spark.conf.unset("dwellgrid.maxGroupRows")
    assert (plain_chunked, was_chunked) == (False, True)
    assert plain == spread


def test_plain_values(spark):
    df = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 2, None), ("a", 3, 3, 2)], "k string, t int, id int, v int")
    _, rows = compute(df)
    assert [r[3:] for r in rows] == [
        (5, 1, 5, 5, 5, -99, -99, -99, 2), (5, 2, 5, 5, 2, 5, 1, 2, 3), (7, 3, 5, 2, 2, -99, 2, -99, -99)
    ]


def test_rows_are_shuffled_without_the_carry(tiny_groups):
    """Only the first row of a chunk needs the carry; it is joined above the window, not sent through its shuffle."""
    rows = tiny_groups.createDataFrame([("k", i, float(i)) for i in range(40)], "key string, i int, v double")
    shifted = OrderedRows.of(rows, ["key"], ["i"]).lag({"p": "v"})
    assert shifted.chunked
    plan = shifted.result()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Window")
    assert {r.i: r.p for r in shifted.result().collect()} == {i: float(i - 1) if i else None for i in range(40)}
