"""Retention policies and clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.plans.sizes import small_side
from huntlake.schema import CLEANUP_LOG
from huntlake.session import scratch_path

# Time columns by preference, tables never cleaned.
TIME_COLUMNS = ("created_at", "timestamp", "created_date")
EXEMPT_TABLES = ("cleanup_log", "schema_migrations")


def time_column(df: DataFrame, candidates: Sequence[str] = TIME_COLUMNS) -> str | None:
    """The first candidate the table has."""
    return next((c for c in candidates if c in df.columns), None)


def expired(ts: str, as_of: datetime, days: int = 0, hours: int = 0) -> Column:
    """Strictly older than the period. NULL for rows without a time: they are neither deleted nor counted."""
    return F.col(ts) < F.lit(as_of - timedelta(days=days, hours=hours)).cast("timestamp_ntz")


def kept(ts: str, as_of: datetime, days: int = 0, hours: int = 0) -> Column:
    """The rest, in a form the Parquet scan can use."""
    cutoff = F.lit(as_of - timedelta(days=days, hours=hours)).cast("timestamp_ntz")
    return F.col(ts).isNull() | (F.col(ts) >= cutoff)


def retention_keep(df: DataFrame, as_of: datetime, days: int = 0, hours: int = 0, ts: str | None = None) -> DataFrame:
    """What stays after clean-up."""
    ts = ts or time_column(df)
    return df if ts is None else df.where(kept(ts, as_of, days, hours))


def retention_report(tables: Mapping[str, DataFrame], days: Mapping[str, int], as_of: datetime, default_days: int = 90,
                     time_columns: Mapping[str, str] | None = None, partition_dates: Mapping[str, str] | None = None) -> DataFrame:
    """Rows to delete per eligible table, zero included; tables without a time column are skipped. ``partition_dates`` names
    the day column of tables stored by day; of those only folders up to the cutoff day are read."""
    parts = []
    for name, df in tables.items():
        ts = (time_columns or {}).get(name) or time_column(df)
        if name in EXEMPT_TABLES or ts is None:
            continue
        period = days.get(name, default_days)
        day = (partition_dates or {}).get(name)
        if day is not None:
            df = df.where(F.col(day) <= F.lit((as_of - timedelta(days=period)).date()))
        parts.append(df.where(expired(ts, as_of, period)).agg(F.count(F.lit(1)).alias("rows_deleted")).select(
            F.lit(name).alias("table_name"), "rows_deleted",
            F.lit(as_of).cast("timestamp_ntz").alias("cleanup_time"), F.lit(period).alias("retention_days")))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no table is eligible for clean-up")
    return out


def log_rows(report: DataFrame, enabled: bool = True) -> DataFrame:
    """Report rows worth logging: something was deleted, and logging is on."""
    return report.where((F.col("rows_deleted") > 0) & F.lit(enabled)).select(*CLEANUP_LOG.names)


def append_log(report: DataFrame, path: str, enabled: bool = True) -> None:
    log_rows(report, enabled).coalesce(1).write.mode("append").parquet(path)  # one row per table


def resolve_policy(targets: DataFrame, policy: DataFrame, kind: str = "kind", subject: str = "subject",
                   value: str = "retention_days", floor: int | None = None) -> DataFrame:
    """Value per (kind, subject): the subject's own entry, else the kind's ``default``. With a floor,
    a missing value becomes the floor and smaller ones are raised to it."""
    own = small_side(policy.where(F.col(subject) != "default").select(kind, subject, F.col(value).alias("_own")))
    base = small_side(policy.where(F.col(subject) == "default").select(kind, F.col(value).alias("_base")))
    found = F.coalesce("_own", "_base")
    if floor is not None:
        found = F.greatest(F.lit(floor), F.coalesce(found, F.lit(floor)))
    return targets.join(own, [kind, subject], "left").join(base, kind, "left").withColumn(value, found) \
        .drop("_own", "_base")


def _fs_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def clean_partitioned(spark: SparkSession, path: str, as_of: datetime, days: int, ts: str = "timestamp",
                      partition: str = "event_date") -> int:
    """Clean a Parquet table partitioned by date, in place. Returns the rows removed.

    Whole partitions before the cutoff day are dropped; only the cutoff day itself is rewritten, by way
    of a copy so that no file is read and replaced at once. Each step can be repeated after a failure.
    """
    cutoff = as_of - timedelta(days=days)
    day = F.lit(cutoff.date())
    table = spark.read.parquet(path)
    past = table.where(F.col(partition) < day)
    old_days = [r[0] for r in past.select(partition).distinct().collect()]  # one value per day folder
    gone = past.count()
    edge = table.where(F.col(partition) == day)
    n_edge = edge.where(expired(ts, as_of, days)).count()
    if n_edge:
        aside = scratch_path(spark, "retention")
        edge.where(kept(ts, as_of, days)).write.parquet(aside)
        copy = spark.read.parquet(aside)
        if copy.isEmpty():
            old_days.append(cutoff.date())
        else:
            copy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        fs, p = _fs_path(spark, aside)
        fs.delete(p, True)
    for d in old_days:
        fs, p = _fs_path(spark, f"{path.rstrip('/')}/{partition}={d}")
        fs.delete(p, True)
    return gone + n_edge
