"""Exact dedup with a heavy-hitter split.

Texts are equal when they agree without white space (0x20, 0x09-0x0D); of equal texts the row with the most code points
of its original text stays, then the one with the smallest id.

1. Each partition runs a Misra-Gries summary of ``COUNTERS`` counters over its digests; the summaries merge by addition
   and subtraction of the ``COUNTERS`` + 1st largest. Every digest above 1 / COUNTERS of the rows survives.
2. The survivors' true counts and winners come from one aggregation with map-side combine; those above
   1 / COUNTERS of the rows are heavy. They number fewer than ``COUNTERS``, so the table of winners may be broadcast.
3. Rows of heavy digests are settled by a broadcast join where they lie. All other rows shuffle by digest into groups,
   each below 1 / COUNTERS of the rows.

Defined results: a null text counts as empty and all empty texts are equal; null ids come after all others; of rows that
agree in length and id one stays. Tables without rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.llm.text import SPACES
from dwellgrid.session import cut_lineage

COUNTERS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", "")


def misra_gries(counts: dict, counters: int) -> dict:
    """At most ``counters`` entries that still hold every key above the (counters + 1)-th share."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may make up more than 1 / counters of the rows: fewer than ``counters`` rows (digest)."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            for entry in batch.column(0).value_counts().to_pylist():
                kept[entry["values"]] = kept.get(entry["values"], 0) + entry["counts"]
            kept = misra_gries(kept, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "n"]
        )

    def merge(part: DataFrame) -> DataFrame:
        # sums first, then the (counters + 1)-th largest sum is taken off, as in the merge of two summaries
        sums = part.groupBy("digest").agg(F.sum("n").alias("n"))
        return sums.orderBy(F.desc("n"), "digest").limit(counters)

    return merge(rows.select("digest").mapInArrow(summary, "digest binary, n long")).select("digest")


def best_first(length: str = "n_chars", key: str = "id") -> list[Column]:
    return [F.desc(length), F.asc_nulls_last(key)]


def winner(length: str = "n_chars", key: str = "id") -> Column:
    """Aggregate: id of the row that stays (most code points, then smallest id, null last)."""
    return F.min(F.struct((-F.col(length)).alias("l"), F.col(key).isNull().alias("none"), F.col(key).alias("id")))


def digest_rows(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """(id, digest, n_chars) and, if asked for, the whole input row as the struct ``row``."""
    cols = [
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
    ]
    return docs.select(*cols, *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))


def heavy_winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, group_size, best) of the digests that make up more than 1 / counters of the rows, written once."""
    suspects = F.broadcast(frequent_digests(rows, counters))  # at most ``counters`` rows
    total = rows.agg(F.count("*").alias("total"))
    sizes = rows.join(suspects, "digest").groupBy("digest").agg(
        F.count("*").alias("group_size"), winner().alias("best")
    )
    heavy = sizes.join(F.broadcast(total), F.col("group_size") * counters > F.col("total")).drop("total")
    return cut_lineage(heavy)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256), one per input row."""
    rows = cut_lineage(digest_rows(docs, id_col, text_col))
    heavy = F.broadcast(heavy_winners(rows, counters))
    place = Window.partitionBy("digest").orderBy(*best_first())
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    light = rows.join(heavy.select("digest"), "digest", "left_anti").select(
        "id", "digest",
        F.first("id").over(whole).alias("keep_id"),
        F.count("*").over(whole).alias("group_size"),
        (F.row_number().over(place) == 1).alias("kept"),
    )
    settled = rows.join(heavy, "digest").select(
        "id", "digest", "n_chars", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.l"))).alias("top"),
    )
    # rows that agree with the winner in id and length are one group each; only the first of them stays
    first = F.row_number().over(Window.partitionBy("digest").orderBy("id"))
    tops = settled.where("top").withColumn("kept", first == 1)
    rest = settled.where("not top").withColumn("kept", F.lit(False))
    columns = ["id", "digest", "keep_id", "group_size", "kept"]
    return (
        light.select(columns).unionByName(tops.select(columns)).unionByName(rest.select(columns))
        .select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept",
                F.lower(F.hex("digest")).alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The input rows without copies: copies of heavy texts go before the shuffle, others within their group."""
    heavy = F.broadcast(heavy_winners(cut_lineage(digest_rows(docs, id_col, text_col)), counters))
    rows = digest_rows(docs, id_col, text_col, carry=True).join(heavy, "digest", "left").where(
        F.col("best").isNull()
        | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.l")))
    )
    place = Window.partitionBy("digest").orderBy(*best_first())
    return rows.withColumn("place", F.row_number().over(place)).where("place = 1").select("row.*")
