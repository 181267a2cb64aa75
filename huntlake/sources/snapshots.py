"""Table snapshots: write, list, expire."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.functions.parse import snapshot_name
from huntlake.operators.compare import content_hash

MIN_RETENTION_DAYS = 90


def write_snapshot(df: DataFrame, root: str, table: str, stamp: str) -> DataFrame:
    """Copy a table to ``root/table/ts=stamp`` and return its manifest row. Use a stamp finer than
    seconds where two snapshots could fall into the same one."""
    target = f"{root.rstrip('/')}/{table}/ts={stamp}"
    df.write.mode("errorifexists").parquet(target)
    copy = df.sparkSession.read.parquet(target)
    return content_hash(copy.withColumn("_all", F.lit(table)), ["_all"]).select(
        F.col("_all").alias("table_name"), F.lit(stamp).alias("stamp"), F.col("n_rows"), F.col("content_hash")
    )


def snapshot_files(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root`` as (path, modificationTime, length); contents are not read."""
    return spark.read.format("binaryFile").load(root).select("path", "modificationTime", "length")


def snapshot_inventory(files: DataFrame, vm_id: str | None = None, config_type: str | None = None) -> DataFrame:
    """Snapshots newest first, optionally of one subject or type."""
    from huntlake.operators.filters import where_all

    named = snapshot_name(files)
    named = where_all(named, vm_id=vm_id, config_type=config_type)
    return named.select(
        "backup_id", "vm_id", "config_type", "timestamp", F.col("length").alias("size")
    ).orderBy(F.desc("timestamp"), "backup_id")


def expired_snapshots(files: DataFrame, as_of: Column, days: int, whole_days: bool = False) -> DataFrame:
    """Snapshot files past retention, as a list; deleting them is a separate step.

    By default a file goes when older than ``max(90, days)`` days. ``whole_days`` is the other
    policy: the age in whole days must exceed ``days``.
    """
    named = snapshot_name(files)
    if whole_days:
        age = F.floor(F.timestamp_diff("SECOND", F.col("modificationTime"), as_of) / 86400)
        gone = age > days
    else:
        floor = max(MIN_RETENTION_DAYS, days)
        gone = F.col("modificationTime") < as_of - F.make_dt_interval(F.lit(floor))
    return named.where(gone)


def delete_files(spark: SparkSession, paths: Mapping | list[str]) -> int:
    """Second step of expiry: remove the listed files. Returns how many went."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        gone += bool(path.getFileSystem(conf).delete(path, False))
    return gone
