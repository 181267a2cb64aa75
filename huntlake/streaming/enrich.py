"""Enrichment of a stream from a table that changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from huntlake.operators.detect import enrich_source


def live_enrich(events: DataFrame, read_table: Callable[[SparkSession], DataFrame], path: str, key: str = "source_system",
                available_now: bool = True) -> StreamingQuery:
    """Write the stream, joined with the table, to Parquet under ``path``, a folder per micro-batch.

    ``read_table`` is called for every micro-batch, so rows added, changed or removed meanwhile count from the next
    one on, and whether the table is broadcast is decided by its size then. A micro-batch that is run again after a
    failure replaces its own folder: every event is written once, as ``enrich_source`` gives it."""

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        enrich_source(batch, read_table(spark), key).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = events.writeStream.foreachBatch(one).option("checkpointLocation", path.rstrip("/") + "-state")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def enriched(spark: SparkSession, path: str) -> DataFrame:
    """What ``live_enrich`` has written so far, with ``batch_id``."""
    return spark.read.parquet(path)
