"""The given ``events`` table seen as security events: fields it lacks are derived from the ones
it has, the same way on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Process name by k % 5.
PROCESSES = ("powershell.exe", "cmd.exe", "svchost.exe", "bash", "python")


def security_events(events: DataFrame) -> DataFrame:
    k = F.col("_k")
    process = F.lit(PROCESSES[-1])
    for i, name in reversed(list(enumerate(PROCESSES[:-1]))):
        process = F.when(k % 5 == i, F.lit(name)).otherwise(process)
    user = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    text = lambda c: c.cast("string")
    # parsed once per row, and not at all when no column needs it
    keyed = events.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    return keyed.select(
        "event_id", "ts", "event_type", "value",
        F.concat(F.lit("src_"), text(F.col("event_id") % 3)).alias("source_system"),
        F.concat(F.lit("10.0."), text(F.col("user_id") % 4), F.lit("."), text(F.col("user_id") % 250)).alias("source_ip"),
        F.concat(F.lit("10.1.0."), text(F.col("event_id") % 50)).alias("destination_ip"),
        user.alias("user_id"),
        process.alias("process_name"),
        F.concat(F.lit("C:\\Users\\"), user, F.lit("\\f"), text(k), F.lit(".txt")).alias("file_path"),
    )
