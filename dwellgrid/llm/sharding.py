"""Sharding by vector bin packing: bytes, words and rows are balanced together.

Documents with equal texts form a group. A group above 1 / ``PARCELS`` of any of the three totals is heavy and is packed
by itself; if it exceeds 1 / ``PIECES`` of a shard, it is split by id, so that copies of one text cannot overload a shard.
All other groups are gathered by digest into ``PARCELS`` parcels. Heavy pieces and parcels together are at most a fixed
number of items whatever the input size; the packing loop over them runs on the driver. Items go, largest first, to the
shard where the dot product of the item with the residual capacity is highest. The rows themselves are never collected:
they get their shard by a join with the item table, and their slot from counts per (shard, bucket of the id) plus a row
number within the bucket.

Law: ``bytes``. Shards are filled to nearly equal sums of ``size`` (UTF-8 bytes plus 1); words and rows follow as far as
the items allow.

Defined results: a null text has no bytes (size 1), crc32 of nothing and belongs with empty texts. Copies stay together
unless their group is split. Rows with the same id and text are interchangeable. No rows, no shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellgrid.llm.text import WORDS
from dwellgrid.session import cut_lineage

SHARDS = 16
PARCELS = 4096
PIECES = 8
MEASURES = ("size", "words", "n")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of bytes, words, rows): largest first, highest dot product with the residual capacity."""
    totals = np.maximum(items.sum(axis=0), 1)
    share = items / totals * shards  # capacity 1 in each measure
    residual = np.ones((shards, items.shape[1]))
    chosen = np.zeros(len(items), int)
    # the law is on bytes: it decides; the other measures settle what bytes leave open
    weight = np.array([1.0, 0.05, 0.05])[: items.shape[1]]
    for i in np.lexsort((np.arange(len(items)), -share[:, 0])):
        chosen[i] = np.argmax((residual * weight) @ share[i])
        residual[chosen[i]] -= share[i]
    return chosen


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, parcels: int = PARCELS
) -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard), one per input row."""
    spark: SparkSession = docs.sparkSession
    rows = cut_lineage(measured(docs, id_col, text_col))
    totals = rows.agg(F.sum("size").alias("t_size"), F.sum("words").alias("t_words"), F.count("*").alias("t_n"))
    groups = rows.groupBy("digest").agg(
        F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("n")
    )
    load = F.greatest(*(F.col(m) * parcels / F.greatest(F.col(f"t_{m}"), F.lit(1)) for m in MEASURES))
    # fewer than 3 * parcels groups can be above 1 / parcels of one of three totals
    heavy = cut_lineage(
        groups.join(F.broadcast(totals), F.lit(True)).withColumn("load", load).where("load > 1")
        .select("digest", F.least(F.ceil(F.col("load") * (shards * PIECES / parcels)), F.col("n")).cast("int").alias("pieces"))
    )
    parcel = F.pmod(F.xxhash64("digest"), F.lit(parcels)).cast("int")
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    placed = rows.join(F.broadcast(heavy), "digest", "left").select(
        "id", "size", "crc", "words",
        F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(piece).alias("piece"),
        F.when(F.col("pieces").isNull(), F.lit(None)).otherwise(F.col("digest")).alias("alone"),
        parcel.alias("parcel"),
    )
    key = ["parcel", "alone", "piece"]
    sums = placed.groupBy(*key).agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("n"))
    items = sums.orderBy(*key).toArrow()  # parcels and heavy pieces only: bounded by a multiple of ``parcels``
    matrix = np.column_stack([items.column(m).to_numpy() for m in MEASURES]).astype(float).reshape(-1, len(MEASURES))
    shard = pack(matrix, shards) if len(matrix) else np.zeros(0, int)
    table = spark.createDataFrame(
        [
            (p, None if a is None else bytearray(a), k, int(s))
            for p, a, k, s in zip(*(items.column(c).to_pylist() for c in key), shard)
        ],
        "k_parcel int, k_alone binary, k_piece int, shard int",
    )
    placed = placed.join(
        F.broadcast(table),
        (F.col("parcel") == F.col("k_parcel")) & F.col("alone").eqNullSafe(F.col("k_alone"))
        & (F.col("piece") == F.col("k_piece")),
    )
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(parcels)).cast("int"))
    before = Window.partitionBy("b_shard").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(F.col("shard").alias("b_shard"), F.col("bucket").alias("b_bucket")).agg(
        F.count("*").alias("rows")
    ).select("b_shard", "b_bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    placed = placed.join(  # at most shards * parcels rows
        F.broadcast(starts), (F.col("shard") == F.col("b_shard")) & (F.col("bucket") == F.col("b_bucket"))
    )
    order = Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size")
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + F.row_number().over(order) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
