"""Writing results and reading them back to check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from huntlake.functions.parse import is_malformed
from huntlake.schema import CHECK_RESULT


def write_events(df: DataFrame, path: str, ts: str = "timestamp", partition: str = "event_date", files: int | None = None,
                 mode: str = "append") -> None:
    """Store events in one folder per day, ordered by time inside each file so that row groups can be
    skipped. Files are cut by range over time, so a busy day becomes more files instead of one task."""
    parts = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        df.withColumn(partition, F.to_date(ts)).repartitionByRange(parts, partition, ts)
        .sortWithinPartitions(partition, ts).write.mode(mode).partitionBy(partition).parquet(path)
    )


def append_verify(df: DataFrame, path: str, batch_id: str) -> DataFrame:
    """Append one batch, read that batch back, and report (batch_id, rows_written, rows_read, ok).

    The batch is its own partition, so reading it back prunes everything else.
    """
    spark = df.sparkSession
    seen = Observation()
    (
        df.withColumn("batch_id", F.lit(batch_id)).observe(seen, F.count(F.lit(1)).alias("rows_written"))
        .write.mode("append").partitionBy("batch_id").parquet(path)
    )
    written = seen.get["rows_written"]
    # with a given schema the folder names stay text: "1" and "001" are two batches
    schema = StructType([*df.schema.fields, StructField("batch_id", StringType())])
    back = spark.read.schema(schema).parquet(path).where(F.col("batch_id") == batch_id)
    return back.agg(F.count(F.lit(1)).alias("rows_read")).select(
        F.lit(batch_id).alias("batch_id"), F.lit(written).cast("long").alias("rows_written"), "rows_read",
        (F.col("rows_read") == written).alias("ok"),
    )


def store_split(df: DataFrame, path: str, corrupt: str = "_corrupt", timestamp: str = "timestamp") -> tuple[DataFrame, DataFrame, dict]:
    """Read the source once, storing good and malformed records side by side. Returns both, read back,
    and their counts as seen while writing."""
    bad = is_malformed(corrupt, timestamp)
    seen = Observation()
    (
        df.withColumn("part", F.when(bad, "quarantine").otherwise("good"))
        .observe(seen, F.count_if(~bad).alias("good"), F.count_if(bad).alias("quarantine"))
        .write.partitionBy("part").parquet(path)
    )
    counts = seen.get
    stored = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("part", StringType())])).parquet(path)
    good = stored.where("part = 'good'").drop("part", corrupt)
    return good, stored.where("part = 'quarantine'").drop("part"), counts


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Analysis results as JSON lines or CSV with a header, from which ``scan_csv`` reads the same values."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
            .option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}")


def check_documents(tests: DataFrame, group: str, timestamp: str, config_file: str) -> DataFrame:
    """One result document per host (the ``group`` column) from (host, name, status) rows: totals plus
    the test list. A document holds the checks of one host, so its size is the number of checks."""
    status = F.col("status")
    return (
        tests.groupBy(group)
        .agg(
            F.struct(
                F.count_if(status == "PASS").alias("passed"),
                F.count_if(status == "FAIL").alias("failed"),
                F.count_if(status == "WARN").alias("warnings"),
                F.count(F.lit(1)).alias("total"),
            ).alias("summary"),
            F.sort_array(F.collect_list(F.struct("name", "status"))).alias("tests"),
        )
        .select(
            F.lit(timestamp).alias("timestamp"), F.col(group).alias("hostname"),
            F.lit(config_file).alias("config_file"), "summary", "tests",
        )
    )


def read_check_results(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Result documents with the file they came from and when it was written."""
    return (
        spark.read.schema(CHECK_RESULT).option("multiLine", multiline).json(path)
        .select("*", F.col("_metadata.file_name").alias("file_name"),
                F.col("_metadata.file_modification_time").alias("modified"))
    )


def explode_tests(results: DataFrame, *keep: str) -> DataFrame:
    return results.select(*keep, F.explode("tests").alias("t")).select(*keep, "t.name", "t.status")


def latest_result(results: DataFrame, prefix: str = "prefix", modified: str = "modified", tie: str = "file_name") -> DataFrame:
    """The newest document per prefix."""
    others = [c for c in results.columns if c != prefix]
    newest = F.max_by(F.struct(*others), F.struct(modified, tie))
    return results.groupBy(prefix).agg(newest.alias("r")).select(prefix, "r.*")
