"""Writers and table merges: JSON lines, insert-ignore, upserts, replace-by-key, partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.scoring import seconds_between
from dwellgrid.operators.quality import first_per_key
from dwellgrid.session import cut_lineage

EVENT_FIELDS = (
    "event_id", "store_id", "camera_id", "visitor_id", "event_type", "timestamp", "zone_id", "dwell_ms", "is_staff",
    "confidence", "metadata",
)

def event_lines(events: DataFrame, *keep: str) -> DataFrame:
    """One JSON text per event with the eleven wire fields, beside the columns to keep."""
    wire = events.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).withColumnRenamed(
        "metadata_json", "metadata"
    )
    return wire.select(F.to_json(F.struct(*EVENT_FIELDS)).alias("value"), *keep)

def write_event_lines(events: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    writer = event_lines(events).write.mode("append")
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.text(path)

def write_camera_feeds(events: DataFrame, path: str) -> None:
    """One folder of JSON lines per camera, whatever cameras there are (none is one of them), from one scan."""
    event_lines(events.withColumn("feed", F.col("camera_id")), "feed").write.mode("append").partitionBy("feed").text(path)

def write_partitioned(events: DataFrame, path: str) -> None:
    """Fact table partitioned by store and day, sorted by time inside the files for row-group pruning.

    Range partitioning spreads a busy store or day over as many writers as its rows need."""
    spread = events.repartitionByRange("store_id", "event_date", "ts")
    spread.sortWithinPartitions("store_id", "event_date", "ts").write.mode("append").partitionBy("store_id", "event_date").parquet(path)


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Existing rows plus the first new row of every unknown key."""
    fresh = first_per_key(new, [key], order).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))

def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with those of the new keys replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)

def overwrite_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions present in ``rows`` (files of other partitions stay)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

def replace_days(path: str, rows: DataFrame, partition: str = "event_date") -> None:
    """Writes merged rows of some partitions over the stored ones. The rows may come from the table itself, so they are
    staged first; files of other partitions stay as they are."""
    overwrite_partitions(cut_lineage(rows), path, partition)

def stored_days(path: str, days: DataFrame, like: DataFrame, partition: str = "event_date") -> DataFrame:
    """Rows of a partitioned table that lie in the given partitions."""
    stored = days.sparkSession.read.schema(like.schema).parquet(path)
    return stored.join(days.select(partition).distinct(), partition, "left_semi").select(like.columns)

def insert_ignore_into(path: str, new: DataFrame, key: str, order: list[str]) -> None:
    """Appends the first new row of every key the table does not hold; a replayed batch adds nothing."""
    existing = new.sparkSession.read.schema(new.schema).parquet(path).select(key)
    fresh = first_per_key(new, [key], order).join(existing, key, "left_anti")
    cut_lineage(fresh.select(new.columns)).write.mode("append").parquet(path)

def upsert_rows_into(path: str, new: DataFrame, keys: list[str], partition: str = "event_date") -> None:
    """Stored rows with those of the new keys replaced; only partitions of new rows are rewritten."""
    staged = cut_lineage(new)
    replace_days(path, replace_rows(stored_days(path, staged, staged, partition), staged, keys), partition)

def upsert_sessions_into(path: str, new: DataFrame, replace_zones: bool = False) -> None:
    """Merges a newer fold into the session table, which is partitioned by ``event_date``, the day of the session's id."""
    staged = cut_lineage(new)
    old = stored_days(path, staged, staged)
    day = F.coalesce("event_date", "n_date").alias("event_date")
    days = old.select("session_id", "event_date").join(
        staged.select("session_id", F.col("event_date").alias("n_date")), "session_id", "full"
    ).select("session_id", day)
    merged = upsert_sessions(old.drop("event_date"), staged.drop("event_date"), replace_zones)
    replace_days(path, merged.join(days, "session_id").select(staged.columns))

def upsert_sessions(old: DataFrame, new: DataFrame, replace_zones: bool = False) -> DataFrame:
    """Stored sessions merged with a newer fold: entry and re-entry stay, exit, dwell, staff flag and zones move on."""
    o = old.select(*[F.col(c).alias("o_" + c) if c != "session_id" else F.col(c) for c in old.columns])
    n = new.select(*[F.col(c).alias("n_" + c) if c != "session_id" else F.col(c) for c in new.columns])
    both = o.join(n, "session_id", "full")

    def newest(c: str):
        return F.coalesce("n_" + c, "o_" + c)

    def kept(c: str):
        return F.coalesce("o_" + c, "n_" + c)

    empty = F.array().cast("array<string>")
    merged = F.array_distinct(F.concat(F.coalesce("o_zones_visited", empty), F.coalesce("n_zones_visited", empty)))
    moved = seconds_between(F.col("n_exit_time"), kept("entry_time"))
    return both.select(
        "session_id", kept("store_id").alias("store_id"), kept("visitor_id").alias("visitor_id"),
        kept("entry_time").alias("entry_time"), newest("exit_time").alias("exit_time"),
        F.coalesce(moved, F.col("o_dwell_seconds")).alias("dwell_seconds"),
        (F.coalesce("o_is_converted", F.lit(False)) | F.coalesce("n_is_converted", F.lit(False))).alias("is_converted"),
        newest("is_staff").alias("is_staff"), kept("is_reentry").alias("is_reentry"),
        (newest("zones_visited") if replace_zones else merged).alias("zones_visited"),
    )

def upsert_zones(existing: DataFrame, new: DataFrame, mode: str) -> DataFrame:
    """``ignore`` keeps known zones as they are; ``overwrite`` takes the new definition."""
    if mode == "ignore":
        return existing.unionByName(new.join(existing.select("store_id", "zone_id"), ["store_id", "zone_id"], "left_anti"))
    return replace_rows(existing, new, ["store_id", "zone_id"])

def register_stores(stores: DataFrame, events: DataFrame, timezone: str = "Asia/Kolkata") -> DataFrame:
    """Store ids seen in events but unknown so far, named by their id, with a default time zone."""
    unknown = events.select("store_id").distinct().join(stores.select("store_id"), "store_id", "left_anti")
    return unknown.select("store_id", F.col("store_id").alias("name"), F.lit(timezone).alias("timezone"))

def register_stores_into(path: str, events: DataFrame) -> None:
    """Appends the unknown stores of a batch to the store table."""
    known = events.sparkSession.read.parquet(path)
    cut_lineage(register_stores(known, events).select(known.columns)).write.mode("append").parquet(path)

def upsert_zones_into(path: str, new: DataFrame, mode: str) -> None:
    """Zone table partitioned by store; only stores of the new rows are rewritten."""
    staged = cut_lineage(new)
    merged = upsert_zones(stored_days(path, staged, staged, "store_id"), staged, mode)
    replace_days(path, merged.select(staged.columns), "store_id")
