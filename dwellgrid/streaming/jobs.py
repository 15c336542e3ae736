"""Running streaming queries against the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from dwellgrid.session import scratch_path

DELAY = "2 hours"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State store with column families, which timers and custom state need."""
    before = spark.conf.get(STORE_CONF, None)
    spark.conf.set(STORE_CONF, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE_CONF)
        else:
            spark.conf.set(STORE_CONF, before)


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Processes everything available into a parquet sink (exactly once) and returns the sink as a table."""
    return continue_job(stream, scratch_path(stream.sparkSession, label), mode)


def continue_job(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Takes up the job whose sink and checkpoint lie below ``path``, processes what has arrived since, and returns the
    whole sink."""
    spark = stream.sparkSession
    job = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], label: str, mode: str = "append") -> None:
    """Processes everything available through ``handle(batch, batch_id)``; handlers must be idempotent per batch id."""
    run_parts([stream], handle, label, mode)


def run_parts(
    streams: Iterable[DataFrame], handle: Callable[[DataFrame, int], None], label: str, mode: str = "append"
) -> None:
    """The same over a feed that grows: each stream is the feed after its next part has arrived, and is taken up from the
    checkpoint of the one before, so a part is one micro-batch however many files it has."""
    path = None
    for stream in streams:
        path = path or scratch_path(stream.sparkSession, label)
        job = (
            stream.writeStream.outputMode(mode).foreachBatch(handle)
            .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        )
        job.awaitTermination()


def batch_path(root: str, batch_id: int) -> str:
    """Own folder per batch, so that a repeated batch overwrites its earlier attempt."""
    return f"{root}/batch={batch_id}"
