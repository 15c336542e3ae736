"""One-to-one matching where choosers take turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.session import DEFAULT_MAX_GROUP_ROWS, MAX_GROUP_ROWS_CONF, cut_lineage, int_setting


def priority_match(
    pairs: DataFrame, within: list[str], chooser: str, item: str, order: list[str], carry: list[str]
) -> DataFrame:
    """Choosers pick, one after the other, their best free item.

    ``order`` sorts the choosers' turns first and each chooser's wishes after them. Conflicts never leave a group of
    ``within`` (one camera frame, say), so a group of up to ``dwellgrid.maxGroupRows`` pairs is settled in one pass of
    its own, whatever the length of its conflict chains.

    Larger groups are thinned by all tasks first: a pair that is the first one left of both its chooser and its item is
    chosen in any order of work, and takes the other pairs of both with it. Rounds go on while they halve the pairs, so
    there are at most log2(pairs) of them. Groups that fit by then are settled as above; what is left is one long chain
    of conflicts, and is read in order with a spilling sort, so that a task holds the taken names and never the pairs.
    """
    names = [chooser, item, *carry]
    turns = list(dict.fromkeys([*order, chooser, item]))
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names)

    def settle(group: pa.Table) -> pa.Table:
        ranked = group.sort_by([(c, "ascending") for c in turns])
        chosen, taken, keep = set(), set(), []
        for at, (c, i) in enumerate(zip(ranked.column(chooser).to_pylist(), ranked.column(item).to_pylist())):
            if c not in chosen and i not in taken:
                chosen.add(c)
                taken.add(i)
                keep.append(at)
        return ranked.take(pa.array(keep, pa.int64())).select(names)

    def settle_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, chosen, taken = None, set(), set()
        for batch in batches:
            keep, keys = [], zip(*[batch.column(c).to_pylist() for c in within])
            for at, (g, c, i) in enumerate(zip(keys, batch.column(chooser).to_pylist(), batch.column(item).to_pylist())):
                if g != group:
                    group, chosen, taken = g, set(), set()
                if c not in chosen and i not in taken:
                    chosen.add(c)
                    taken.add(i)
                    keep.append(at)
            yield batch.take(pa.array(keep, pa.int64())).select(names)

    rest = cut_lineage(pairs)
    limit = int_setting(pairs.sparkSession, MAX_GROUP_ROWS_CONF, DEFAULT_MAX_GROUP_ROWS)
    fits, crowded = _by_size(rest, within, limit)
    out, left = fits.groupBy(*within).applyInArrow(settle, kinds), crowded.count()
    while left:
        flagged = cut_lineage(_first_of_both(crowded, within, chooser, item, turns))
        out = out.unionByName(flagged.where("_chosen").select(names))
        rest = flagged.where("_free").select(pairs.columns)
        fits, crowded = _by_size(rest, within, limit)
        out, before, left = out.unionByName(fits.groupBy(*within).applyInArrow(settle, kinds)), left, crowded.count()
        if left > before / 2:
            ranked = crowded.repartition(*within).sortWithinPartitions(*within, *[F.col(c).asc_nulls_last() for c in turns])
            return out.unionByName(ranked.mapInArrow(settle_sorted, kinds))
    return out


def _by_size(pairs: DataFrame, within: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of groups with up to ``limit`` of them, and those of larger groups."""
    large = pairs.groupBy(*[F.col(c).alias("_" + c) for c in within]).count().where(F.col("count") > limit).drop("count")
    same = F.lit(True)
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    return pairs.join(large, same, "left_anti"), pairs.join(large, same, "left_semi")


def _first_of_both(pairs: DataFrame, within: list[str], chooser: str, item: str, turns: list[str]) -> DataFrame:
    """Flags the pairs that are first for their chooser and for their item, and those that share neither with them.

    Windows run over the pairs of one chooser or one item, not over a group."""
    def place(c: str) -> Column:
        return F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value"))

    by_chooser, by_item = Window.partitionBy(*within, chooser), Window.partitionBy(*within, item)
    ranked = pairs.withColumn("_rank", F.struct(*[place(c).alias(f"r{n}") for n, c in enumerate(turns)]))
    both = ranked.withColumn("_c", F.min("_rank").over(by_chooser)).withColumn("_i", F.min("_rank").over(by_item))
    first = both.withColumn("_chosen", (F.col("_rank") == F.col("_c")) & (F.col("_rank") == F.col("_i"))).drop("_rank", "_c", "_i")
    gone = first.withColumn("_item_gone", F.max("_chosen").over(by_item)).withColumn("_gone", F.max("_chosen").over(by_chooser))
    return gone.withColumn("_free", ~F.col("_item_gone") & ~F.col("_gone")).drop("_item_gone", "_gone")
