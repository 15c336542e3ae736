"""Session helpers: settings, shared scratch folder and reliable lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_GROUP_ROWS_CONF = "dwellgrid.maxGroupRows"
BROADCAST_BYTES_CONF = "dwellgrid.broadcastBytes"
DEFAULT_MAX_GROUP_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 << 20
FILE_GROWTH = 8  # rows in memory against their compressed files


def build_session(app: str = "dwellgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution; cluster settings stay with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def int_setting(spark: SparkSession, name: str, default: int) -> int:
    value = spark.conf.get(name, None)
    return default if value is None else int(value)


_own_dir: str | None = None
_stages: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Only in local mode, and only if none is set, a folder of
    our own that goes when the process ends."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="dwellgrid-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        configured = _own_dir
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, remembered until ``drop_stages``."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _stages.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Deletes what this session has staged; call it when the results that were built on it are written."""
    paths = _stages.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder and read back: a lost executor never loses them.

    Unlike a checkpoint this computes the plan once, and later reads fetch only the columns they need.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint behind a check of bytes; otherwise the join is left to the optimizer.

    The rows are staged once, so the check does not run their plan a second time."""
    staged = cut_lineage(df)
    limit = int_setting(df.sparkSession, BROADCAST_BYTES_CONF, DEFAULT_BROADCAST_BYTES)
    size = int(staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(staged) if size * FILE_GROWTH <= limit else staged
