"""Ordered per-key computations that stay balanced when one key is hot.

A plain window sends every row of a key to one task. ``OrderedRows`` measures the largest key
first. Small keys use a plain window. If any key is too large, the rows are range-partitioned on
(keys, order), so a hot key is spread over many contiguous chunks; each function is then computed
per (key, chunk) and completed with a carry taken from the earlier chunks of the key. The carry
table has one row per (key, chunk), never one per input row.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.session import DEFAULT_MAX_GROUP_ROWS, MAX_GROUP_ROWS_CONF, cut_lineage, int_setting

CHUNK = "_chunk"


class OrderedRows:
    """Rows grouped by ``keys`` and totally ordered by ``order`` (end it with a unique column)."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunked: bool = False):
        self.df, self.keys, self.order, self.chunked = df, list(keys), list(order), chunked

    @classmethod
    def of(
        cls, df: DataFrame, keys: Sequence[str], order: Sequence[str], inside: "OrderedRows | None" = None
    ) -> "OrderedRows":
        """Measures the groups; ``inside`` names measured rows whose groups contain these groups."""
        if inside is not None and not inside.chunked:
            return cls(df, keys, order)
        limit = int_setting(df.sparkSession, MAX_GROUP_ROWS_CONF, DEFAULT_MAX_GROUP_ROWS)
        sizes = (
            df.groupBy(*keys).agg(F.count("*").alias("n"))
            .agg(F.max("n").alias("largest"), F.sum("n").alias("total")).first()
        )
        if (sizes["largest"] or 0) <= limit:
            return cls(df, keys, order)
        parts = max(ceil(sizes["total"] / limit) * 2, 2)
        spread = df.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
        return cls(cut_lineage(spread), keys, order, chunked=True)

    @property
    def _groups(self) -> list[str]:
        return self.keys + ([CHUNK] if self.chunked else [])

    def _window(self, forward: bool = True):
        """Rows in order; backward windows sort descending, as frames to the end cost quadratic time."""
        turn = F.asc if forward else F.desc
        return Window.partitionBy(*self._groups).orderBy(*[turn(c) for c in self.order])

    def _with(self, df: DataFrame) -> "OrderedRows":
        return OrderedRows(df, self.keys, self.order, self.chunked)

    def _carry(self, per_chunk: DataFrame, name: str, value: Column, forward: bool = True) -> DataFrame:
        """Join ``name``: ``value`` over the chunks of the key before (or after) the current one."""
        carry, cond = self._carried(per_chunk, name, value, forward)
        return self.df.join(carry, cond, "left").select(*self.df.columns, name)

    def _carried(self, per_chunk: DataFrame, name: str, value: Column, forward: bool) -> tuple[DataFrame, Column]:
        """``value`` over the chunks before (or after) each chunk as ``name``, and the condition that joins it to rows."""
        step = F.asc(CHUNK) if forward else F.desc(CHUNK)
        w = Window.partitionBy(*self.keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(self._groups)]
        carry = per_chunk.select(*renamed, value.over(w).alias(name))
        cond = F.lit(True)
        for i, k in enumerate(self._groups):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return carry, cond

    def running_sum(self, name: str, value: Column) -> "OrderedRows":
        """Inclusive running total."""
        local = F.sum(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0))
        if not self.chunked:
            return self._with(self.df.withColumn(name, local))
        totals = self.df.groupBy(*self._groups).agg(F.sum(value).alias("_t"))
        joined = self._carry(totals, "_c", F.sum("_t"))
        return self._with(joined.withColumn(name, local + F.coalesce("_c", F.lit(0))).drop("_c"))

    def row_number(self, name: str) -> "OrderedRows":
        numbered = self.running_sum(name, F.lit(1))
        return self._with(numbered.df.withColumn(name, F.col(name).cast("long")))

    def running_max(self, name: str, value: Column) -> "OrderedRows":
        """Inclusive running maximum (nulls ignored)."""
        local = F.max(value).over(self._window().rowsBetween(Window.unboundedPreceding, 0))
        if not self.chunked:
            return self._with(self.df.withColumn(name, local))
        tops = self.df.groupBy(*self._groups).agg(F.max(value).alias("_t"))
        joined = self._carry(tops, "_c", F.max("_t")).withColumn(name, local)
        merged = F.when(F.col("_c").isNull(), F.col(name)).when(F.col(name).isNull(), F.col("_c")).otherwise(
            F.greatest("_c", name)
        )
        return self._with(joined.withColumn(name, merged).drop("_c"))

    def last_value(self, name: str, value: Column, inclusive: bool = True) -> "OrderedRows":
        """Latest non-null value so far (an as-of lookup)."""
        frame = self._window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        local = F.last(value, ignorenulls=True).over(frame)
        if not self.chunked:
            return self._with(self.df.withColumn(name, local))
        ends = self.df.groupBy(*self._groups).agg(
            F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))).alias("_t")
        )
        joined = self._carry(ends, "_c", F.last("_t", ignorenulls=True))
        return self._with(joined.withColumn(name, F.coalesce(local, "_c")).drop("_c"))

    def next_value(self, name: str, value: Column) -> "OrderedRows":
        """First non-null value at or after the row."""
        back = self._window(forward=False).rowsBetween(Window.unboundedPreceding, 0)
        local = F.last(value, ignorenulls=True).over(back)
        if not self.chunked:
            return self._with(self.df.withColumn(name, local))
        starts = self.df.groupBy(*self._groups).agg(
            F.min_by(value, F.when(value.isNotNull(), F.struct(*self.order))).alias("_t")
        )
        joined = self._carry(starts, "_c", F.last("_t", ignorenulls=True), forward=False)
        return self._with(joined.withColumn(name, F.coalesce(local, "_c")).drop("_c"))

    def lag(self, columns: dict[str, str]) -> "OrderedRows":
        """Values of the previous row of the key: ``{new name: source column}``."""
        return self._shift(columns, forward=True)

    def lead(self, columns: dict[str, str]) -> "OrderedRows":
        """Values of the next row of the key: ``{new name: source column}``."""
        return self._shift(columns, forward=False)

    def _shift(self, columns: dict[str, str], forward: bool) -> "OrderedRows":
        shift = F.lag if forward else F.lead
        w = self._window()
        packed = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
        keep = [F.col(c) for c in self.df.columns]
        if not self.chunked:
            return self._with(self.df.select(*keep, *[shift(src).over(w).alias(new) for new, src in columns.items()]))
        pick = F.max_by if forward else F.min_by
        edge = self.df.groupBy(*self._groups).agg(pick(packed, F.struct(*self.order)).alias("_t"))
        # only the first row of a chunk takes the carry, so it is joined behind the shuffle of the rows
        carry, cond = self._carried(edge, "_c", F.last("_t"), forward)
        first = shift(F.lit(True)).over(w).isNull()
        local = self.df.select(*keep, first.alias("_first"), *[shift(src).over(w).alias(f"_s_{new}") for new, src in columns.items()])
        joined = local.join(F.broadcast(carry), cond & F.col("_first"), "left")
        return self._with(joined.select(*keep, *[
            F.when(F.col("_first"), F.col(f"_c.{new}")).otherwise(F.col(f"_s_{new}")).alias(new) for new in columns
        ]))

    def where(self, condition: Column) -> "OrderedRows":
        return self._with(self.df.where(condition))

    def with_column(self, name: str, value: Column) -> "OrderedRows":
        """Adds a plain row expression."""
        return self._with(self.df.withColumn(name, value))

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)
