"""Stored audit rows: each request once, however often a batch is sent, and nothing revealed that is not stored."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.operators.privacy import deanonymization_audit, deanonymize, decrypt
from huntlake.schema import AUDIT
from huntlake.session import pin
from huntlake.sources.files import Files

DEANONYMIZATION = T.StructType([
    T.StructField("user", T.StringType()), T.StructField("timestamp", T.TimestampNTZType()), T.StructField("field", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("approval", T.StringType()), T.StructField("revealed", T.BooleanType()),
    T.StructField("request_id", T.LongType()),
])


@dataclass
class AuditStore:
    """A Parquet table in one folder per day of ``ts``. Rows are known by ``key``; a row with a key and day that is stored is not stored
    again. The day is part of the identity, so only the days of a batch are read, never the history."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: Sequence[str]
    ts: str
    day: str = "audit_day"

    def read(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(self.day, T.DateType())])
        if not Files(self.spark).exists(self.path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(self.path)

    def stored(self, batch: DataFrame) -> DataFrame:
        """The stored rows of the days that ``batch`` has rows of."""
        days = [r[0] for r in batch.select(self.day).distinct().collect()]  # one row per day of the batch
        return self.read().where(F.col(self.day).isin([d for d in days if d is not None]) | (F.col(self.day).isNull() & F.lit(None in days)))

    def append(self, rows: DataFrame) -> DataFrame:
        """Store the rows that are not there yet; returns the rows appended. Of rows with one key in ``rows`` the least is stored. A call that
        is killed has stored some rows or none; repeating it stores the rest. One writer at a time."""
        names = self.schema.names
        # maps have no order and no equality; they are stored as JSON text with sorted keys
        plain = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c)
        rows = rows.select(*[plain(c) if isinstance(rows.schema[c].dataType, T.MapType) else c for c in names])
        one = F.min(F.struct(*[c for c in names if c not in self.key])).alias("r")
        rows = rows.groupBy(*self.key).agg(one).select(*self.key, "r.*").withColumn(self.day, F.to_date(self.ts))
        rows = pin(rows)
        have = self.stored(rows).select(self.day, *self.key)
        same = rows[self.day].eqNullSafe(have[self.day])
        for k in self.key:
            same = same & rows[k].eqNullSafe(have[k])
        fresh = pin(rows.join(have, same, "left_anti").select(*names, self.day))
        if not fresh.isEmpty():
            fresh.repartition(F.col(self.day)).write.mode("append").partitionBy(self.day).parquet(self.path)
        return fresh


def operations_store(spark: SparkSession, path: str) -> AuditStore:
    """``audit_logs``: operations as ``parse_audit`` gives them, ``extra`` as JSON. An operation is known by who did what, where and when."""
    rows = T.StructType([f if f.name != "extra" else T.StructField("extra", T.StringType()) for f in AUDIT.fields])
    return AuditStore(spark, path, rows, ("user_id", "vm_id", "operation", "start"), "start")


def deanonymization_store(spark: SparkSession, path: str) -> AuditStore:
    return AuditStore(spark, path, DEANONYMIZATION, ("request_id",), "timestamp")


def deanonymize_logged(requests: DataFrame, mappings: DataFrame, levels: DataFrame, approvals: DataFrame, key: str,
                       store: AuditStore, **options) -> DataFrame:
    """``deanonymize``, with every request stored first. The answers are joined with the rows read back: a value is
    revealed only where a stored row says that it was, so without the store, or with a row that was stored as
    denied, nothing is revealed; an answer without its row is not returned at all. Answers have ``logged_at``, the day of their row."""
    answers = deanonymize(requests, mappings, levels, approvals, key, **options)
    batch = pin(answers.drop("original_value").withColumn(store.day, F.to_date("req_ts")))
    store.append(deanonymization_audit(batch))
    back = store.stored(batch).select(F.col("request_id").alias("_id"), F.col("revealed").alias("_said"), F.col("user").alias("_user"),
                                      F.col("approval").alias("reason_code"), F.col(store.day).alias("logged_at"))
    shown = batch.drop("reason_code", store.day).join(back, (F.col("request_id") == F.col("_id")) & (F.col("user") == F.col("_user")))
    shown = shown.withColumn("revealed", F.col("revealed") & F.col("_said")).drop("_id", "_said", "_user")
    known = mappings.select("anonymized_value", "field_type", F.col("original_value").alias("_value")).dropDuplicates(["anonymized_value", "field_type"])
    return shown.join(known, ["anonymized_value", "field_type"], "left").withColumn(
        "original_value", F.when(F.col("revealed"), decrypt(F.col("_value"), key))).drop("_value")
