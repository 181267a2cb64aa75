"""The live path: the same functions as in batch, with watermarks and bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from huntlake.session import scratch_path

WATERMARK = "1 hour"


def live_table(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
               max_bytes: int = 64 << 30) -> DataFrame:
    """New Parquet files of a folder. ``max_bytes`` bounds one micro-batch."""
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def event_time(df: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_available(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Process everything there is with exactly-once file output, then read it back."""
    path = path or scratch_path(df.sparkSession, name)
    start_available(df, path).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def start_available(df: DataFrame, path: str) -> StreamingQuery:
    """Process what is there into Parquet files and stop; a later call with the same path goes on from there."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", path + "-state")
        .trigger(availableNow=True).start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped so far because they came after the watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def tumbling_counts(df: DataFrame, ts: str = "ts", width: str = "1 hour", *keys: str) -> DataFrame:
    """Counts per window and key; a window is emitted once, when the watermark passes its end."""
    return (
        event_time(df, ts).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
    )


def sliding_bursts(df: DataFrame, source: str = "source_ip", ts: str = "ts", width: str = "10 minutes",
                   slide: str = "1 minute", maxretry: int = 5) -> DataFrame:
    """Sources with at least ``maxretry`` failures in a sliding window."""
    return (
        event_time(df, ts).groupBy(F.window(ts, width, slide).alias("w"), source).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= maxretry)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), source, "n")
    )


def live_sessions(df: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """Closed sessions; the end is the last event plus the gap."""
    return (
        event_time(df, ts).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
    )


def live_dedup(df: DataFrame, *key: str, ts: str = "ts") -> DataFrame:
    """The first row per key; keys are remembered for as long as the watermark delay."""
    return event_time(df, ts).dropDuplicatesWithinWatermark(list(key))
