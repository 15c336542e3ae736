"""Mixing sources to target weights by weighted fair queueing.

Every source offers its documents in a shuffled order that depends on ids alone, up to ``PASSES`` times over. A document
gets as virtual finish time the source's words up to its end divided by the source's weight. All sources are served
together until the budget (the words of all documents) is used up: at virtual time v a source of weight w has given
min(w * v, PASSES * size) words, which are also the targets (a source that runs out leaves its share to the others by
weight). A document whose finish time is at most the closing time is taken whole; the one a source is serving at the
closing time is cut there, so that a source gives its target to the word.

Running sums never put a source into one task: the shuffled order is cut into buckets of the shuffle key, bucket totals
are summed up first, and only bucket rows are sorted. The number of buckets follows the number of rows.

Defined results: sources are ranked by code point, null last, and weights repeat in that order. Size is the number of
words; null or wordless texts have size 0 and are taken with 0 words. Rows with the same id, source and size are
interchangeable. Without words all targets are 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.llm.text import WORDS
from dwellgrid.operators.ordered import OrderedRows
from dwellgrid.session import cut_lineage

WEIGHTS = (5, 2, 1)
PASSES = 3
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, weight, target) from (source, size); one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1  # one row per source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("empty_at", passes * F.col("source_size") / F.col("weight"))
    # sources run dry in the order of empty_at; closing time if exactly those before a row have run dry:
    order = Window.orderBy("empty_at", F.asc_nulls_last("source"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    given = F.coalesce(F.sum(passes * F.col("source_size")).over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    closing = (F.sum("source_size").over(every) - given) / weight_left
    # the candidates rise up to the true closing time and fall after it
    final = F.max("closing").over(every)
    return ranked.withColumn("closing", closing).select(
        "source", "source_size", "weight",
        F.least(F.col("weight") * final, (passes * F.col("source_size")).cast("double")).alias("target"),
    )


def fair_queue(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, passes: int = PASSES,
) -> DataFrame:
    """Rows (id, source, size, source_size, target, taken, finish) in the order of the mix, one per input row.

    ``taken`` counts words, repeats included; ``finish`` is the virtual finish time of the first pass, a further pass
    ends ``source_size`` words later.
    """
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("draw"),
    ))
    targets = cut_lineage(source_targets(rows, weights, passes))
    buckets = 1 << max(0, math.ceil(math.log2(max(1, rows.count()) / BUCKET_ROWS)))
    bucket = F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("start"),
    )
    inside = (
        Window.partitionBy("source", "bucket").orderBy("draw", "id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    placed = placed.withColumn("begin", F.col("start") + F.col("inside")).drop("s", "b")
    known = targets.withColumnRenamed("source", "t")
    mixed = placed.join(known, F.col("source").eqNullSafe(F.col("t")))
    quota = F.round("target").cast("long")
    served = sum(
        (F.greatest(F.lit(0).cast("long"), F.least("size", quota - F.col("source_size") * p - F.col("begin")))
         for p in range(passes)), F.lit(0).cast("long"),
    )
    return mixed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        served.alias("taken"), ((F.col("begin") + F.col("size")) / F.col("weight")).alias("finish"),
        (F.col("source_size") / F.col("weight")).alias("lap"), "draw",
    ).orderBy("finish", "draw").drop("draw")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, passes: int = PASSES,
) -> DataFrame:
    """The mix itself: the input rows, each as often as it is taken, range-sorted by finish time.

    Texts stay whole: the one document of a source that is in service at the closing time comes once more if at least
    half of it is taken, so a source misses its target by at most half a document. Rows that agree in id, source and size
    are taken as often as planned for them together, those of smaller text hashes first.
    """
    plan = fair_queue(docs, id_col, text_col, source_col, weights, passes).where("size > 0")
    copies = F.floor(F.col("taken") / F.col("size")) + F.when(2 * (F.col("taken") % F.col("size")) >= F.col("size"), 1).otherwise(0)
    shares = cut_lineage(
        plan.groupBy(F.col(id_col).alias("k_id"), F.col(source_col).alias("k_source"), F.col("size").alias("k_size")).agg(
            F.min(copies).alias("least"), F.sum(copies).alias("total"), F.count("*").alias("n"),
            F.min("finish").alias("finish"), F.min("lap").alias("lap"),
        ).where("total > 0").withColumn("extra", F.col("total") - F.col("least") * F.col("n"))
    )
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row").getField(text_col)
    planned = rows.withColumn("size", word_count(text)).join(
        shares,
        F.col("row").getField(id_col).eqNullSafe(F.col("k_id")) & (F.col("size") == F.col("k_size"))
        & F.col("row").getField(source_col).cast("string").eqNullSafe(F.col("k_source")),
    )
    # rows of one id, source and size follow each other, so only the few groups at a closing point are taken unevenly
    even = planned.where("extra = 0").withColumn("times", F.col("least"))
    if not shares.where("extra > 0").isEmpty():
        apart = planned.where("extra > 0").withColumn("group", F.xxhash64("k_id", "k_source", "k_size"))
        numbered = OrderedRows.of(apart.withColumn("hash", F.xxhash64(text)), ["group"], ["hash"]).row_number("place").result()
        times = F.col("least") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
        even = even.unionByName(numbered.withColumn("times", times).select(even.columns))
    laps = F.explode(F.sequence(F.lit(0), (F.col("times") - 1).cast("int")))
    mixed = even.where("times > 0").withColumn("lap_no", laps).withColumn("due", F.col("finish") + F.col("lap_no") * F.col("lap"))
    return mixed.repartitionByRange("due").sortWithinPartitions("due").select("row.*")
