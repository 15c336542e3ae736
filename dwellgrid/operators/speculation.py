"""Order-dependent folds per key, run in parallel by speculation.

A key's timeline is cut into chunks and all chunks are folded at once from an empty state. Then each chunk gets the state
in which its predecessor ended, without what is forgotten by its first row; chunks whose start differs from the one they
were folded with are folded again, until no start changes. The first chunk of a key is right at once, so every round
settles at least one more, and a state that does not outlast a chunk ends the chain early.

From the second repetition on, neighbours that are still open are folded as one run, from the start of its first chunk, and
a run takes in twice as many of the following chunks as in the round before: a chain through all chunks needs a number of
rounds that grows with the logarithm of its length. A key with many rows within the reach of its memory never forgets all
it holds, so its chunks would be folded in vain: it is one chunk. A task reads the sorted rows of its runs as a stream and
holds the state of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from dwellgrid.session import broadcast_if_small, cut_lineage

CROWDED = 1000  # rows in a stretch of the timeline, on average, from which a key is one chunk

#: start state -> (output row of the next row, end state so far); states are lists of dicts
Fold = Callable[[list[dict]], tuple[Callable[[dict], tuple], Callable[[], list[dict]]]]
#: the same with the output rows of the next rows
FoldMany = Callable[[list[dict]], tuple[Callable[[list[dict]], list[tuple]], Callable[[], list[dict]]]]


def in_chunks(rows: DataFrame, keys: list[str], time: str, width: int, chunk_rows: int) -> DataFrame:
    """Adds the number of the chunk within the key, from 1: runs of whole stretches of ``width`` with about
    ``chunk_rows`` rows; all of a crowded key."""
    placed = rows.withColumn("slot", F.floor(F.col(time) / width))
    sizes = placed.groupBy(*keys, "slot").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    in_time = whole.orderBy("slot")  # one row per stretch of the timeline
    running = sizes.withColumn("cut", F.floor((F.sum("n").over(in_time) - F.col("n")) / chunk_rows)).withColumn(
        "cut", F.when(F.avg("n").over(whole) < CROWDED, F.col("cut")).otherwise(0)
    )
    numbered = running.withColumn("chunk", F.dense_rank().over(whole.orderBy("cut")).cast("long"))
    other = numbered.select(*(F.col(k).alias(f"o_{k}") for k in keys), F.col("slot").alias("o_slot"), "chunk")
    found = placed.join(broadcast_if_small(other), _same([*keys, "slot"], "o_"))
    return found.drop(*(f"o_{k}" for k in keys), "o_slot", "slot")


def _same(names: list[str], prefix: str) -> Column:
    both = F.lit(True)
    for name in names:
        both = both & F.col(name).eqNullSafe(F.col(prefix + name))
    return both


def _named(df: DataFrame, names: list[str], prefix: str, *others: Column | str) -> DataFrame:
    return df.select(*(F.col(n).alias(prefix + n) for n in names), *others)


def fold_in_rounds(
    chunks: DataFrame, keys: list[str], order: list[str], fold: Fold | FoldMany, output: str, state: str, time: str,
    remembered: Callable[[Column, Column], Column], many: bool = False,
) -> DataFrame:
    """Output rows (keys, ``output``) of folding each key's rows in ``order``.

    ``chunks`` has a column ``chunk`` (see ``in_chunks``), ``state`` is the struct type of one entry of the state, and
    ``remembered(entry, time)`` tells whether an entry still matters to a row at ``time``. With ``many`` the fold takes
    the next rows of a chunk as a list, in pieces of any size.
    """
    spark, place = chunks.sparkSession, [*keys, "chunk"]
    chunks = cut_lineage(chunks)
    entries = f"array<{state}>"
    whole = StructType([
        *(chunks.schema[k] for k in place), *_parse_datatype_string(output).fields,
        *_parse_datatype_string(f"state {entries}").fields,
    ])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in whole.fields])
    width = len(whole.fields) - len(place) - 1
    read = [c for c in chunks.columns if c not in place]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of runs in order, each run behind a row with its start; after each chunk a row with its end."""
        here = of_run = fed = None
        place_of_here: tuple = ()
        start: list[dict] = []

        def end() -> tuple:
            return (*place_of_here, *[None] * width, ended())

        for batch in batches:
            out = []
            turns, numbers = (batch.column(c).fill_null(-1).to_numpy() for c in ("turn", "chunk"))  # a head has no chunk
            cuts = np.flatnonzero((turns[1:] != turns[:-1]) | (numbers[1:] != numbers[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(turns)]):
                if low == high:
                    continue
                piece, chunk = batch.slice(low, high - low), (int(turns[low]), int(numbers[low]))
                if chunk[0] != of_run:
                    if here is not None:
                        out.append(end())
                    of_run, here, start = chunk[0], None, []
                if chunk[1] < 0:
                    start = piece.column("state")[0].as_py() or []
                    continue
                if chunk != here:
                    if here is not None:
                        out.append(end())
                        start = out[-1][-1]
                    here, (fed, ended) = chunk, fold(start)
                    place_of_here = (*(piece.column(k)[0].as_py() for k in keys), chunk[1])
                rows = _rows(piece.select(read))
                out.extend((*place_of_here, *found, None) for found in (fed(list(rows)) if many else map(fed, rows)))
            if out:
                yield _batch(out, arrow)
        if here is not None:
            yield _batch([end()], arrow)

    def folded_from(rows: DataFrame, starts: DataFrame, tasks: int) -> DataFrame:
        """``rows`` with a column ``run``, ``starts`` with the state of each run and its number ``turn``."""
        lines = rows.withColumn("head", F.lit(False)).unionByName(
            starts.withColumn("head", F.lit(True)), allowMissingColumns=True)
        dealt = lines.repartitionById(tasks, "turn").sortWithinPartitions(*keys, "run", F.desc("head"), "chunk", *order)
        return dealt.mapInArrow(run, whole)

    begins = cut_lineage(_named(chunks.groupBy(*place).agg(F.min(time).alias("begin"), F.count("*").alias("rows")),
                                place, "b_", "begin", "rows"))
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def fold_runs(dirty: DataFrame) -> DataFrame:
        """Chunks ``dirty`` (place, run, state of the run's first chunk) folded in their runs, dealt by size over tasks."""
        runs = dirty.join(begins, _same(place, "b_")).groupBy(*keys, "run").agg(F.sum("rows").alias("rows"))
        turns = runs.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("rows"), *keys, "run")))  # one row a run
        turns = cut_lineage(_named(turns, [*keys, "run"], "t_", "turn"))
        heads = dirty.where(F.col("chunk") == F.col("run")).join(turns, _same([*keys, "run"], "t_")).select(
            *keys, "run", "turn", "state")
        members = _named(dirty.join(turns, _same([*keys, "run"], "t_")), place, "d_", "run", "turn")
        rows = chunks.join(broadcast_if_small(members), _same(place, "d_")).drop(*(f"d_{k}" for k in place))
        return folded_from(rows, heads, max(1, min(4 * most, turns.count())))

    nothing = F.array().cast(entries)
    first = begins.select(*(F.col(f"b_{k}").alias(k) for k in place), F.col("b_chunk").alias("run"), nothing.alias("state"))
    folded = cut_lineage(fold_runs(first))
    used = spark.createDataFrame([], StructType([*(chunks.schema[k] for k in place), whole["state"]]))
    reach = 0  # chunks after an open one that its run takes in; none in the first repetition, where no runs are made
    while True:
        ends = folded.where(F.col("state").isNotNull()).select(*keys, (F.col("chunk") + 1).alias("chunk"), "state")
        kept = F.filter("state", lambda entry: remembered(entry, F.col("begin")))
        starts = ends.join(begins, _same(place, "b_")).select(*place, kept.alias("state"))
        compared = cut_lineage(
            starts.join(_named(used, place, "u_", F.col("state").alias("u_state")), _same(place, "u_"), "left")
            .withColumn("moved", F.col("state") != F.coalesce("u_state", nothing))
            .select(*place, "state", "moved")
        )
        moved = compared.where("moved").drop("moved")
        if moved.isEmpty():
            return folded.where(F.col("state").isNull()).drop("chunk", "state")
        dirty = cut_lineage(_in_runs(moved, begins, keys, reach) if reach else moved.withColumn("run", F.col("chunk")))
        again = _named(dirty, place, "b_")
        kept_rows = folded.join(broadcast_if_small(again), _same(place, "b_"), "left_anti")
        folded = cut_lineage(kept_rows.unionByName(fold_runs(dirty)))
        used = _used(compared, dirty, folded, begins, place, remembered)
        reach = reach * 2 or 4


def _in_runs(moved: DataFrame, begins: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """The open chunks and the ``reach`` - 1 after each, with the first chunk of their run of neighbours."""
    place = [*keys, "chunk"]
    taken = moved.select(*keys, F.explode(F.sequence("chunk", F.col("chunk") + reach - 1)).alias("chunk")).distinct()
    known = taken.join(begins, _same(place, "b_"), "left_semi")
    in_turn = Window.partitionBy(*keys).orderBy("chunk")  # one row per chunk
    opens = F.lag("chunk").over(in_turn).eqNullSafe(F.col("chunk") - 1)
    runs = known.withColumn("opens", F.when(~opens, F.col("chunk"))).withColumn("run", F.max("opens").over(in_turn))
    states = _named(moved, place, "m_", "state")
    return runs.join(states, _same(place, "m_"), "left").select(*place, "run", "state")


def _used(
    compared: DataFrame, dirty: DataFrame, folded: DataFrame, begins: DataFrame, place: list[str],
    remembered: Callable[[Column, Column], Column],
) -> DataFrame:
    """Start of each chunk in its last fold: within a run the end of the chunk before, elsewhere the start it was given."""
    inside = dirty.where(F.col("chunk") != F.col("run"))
    ends = folded.where(F.col("state").isNotNull()).select(*place[:-1], (F.col("chunk") + 1).alias("chunk"), "state")
    kept = F.filter("state", lambda entry: remembered(entry, F.col("begin")))
    own = ends.join(_named(inside, place, "i_"), _same(place, "i_"), "left_semi").join(begins, _same(place, "b_")).select(
        *place, kept.alias("state"))
    given = compared.select(*place, "state").join(_named(inside, place, "i_"), _same(place, "i_"), "left_anti")
    return cut_lineage(given.unionByName(own))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows as dicts; lists of numbers without gaps are numpy views of the batch."""
    names = batch.schema.names
    for values in zip(*(_values(batch.column(i)) for i in range(len(names)))):
        yield dict(zip(names, values))


def _values(column: pa.Array) -> list:
    if not pa.types.is_list(column.type) or not pa.types.is_floating(column.type.value_type) or column.values.null_count:
        return column.to_pylist()
    numbers, ends = column.values.to_numpy(), column.offsets.to_pylist()
    there = column.is_valid().to_pylist()
    return [numbers[a:b] if known else None for a, b, known in zip(ends, ends[1:], there)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*rows), schema)], schema=schema)
