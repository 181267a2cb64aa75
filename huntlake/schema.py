"""Schemas of the event table and the tables around it."""

from pyspark.sql import types as T

METADATA = T.StructType([
    T.StructField("anonymized", T.BooleanType()),
    T.StructField("pii_fields", T.ArrayType(T.StringType())),
])

EVENT_TEXT_FIELDS = (
    "source_system", "event_type", "source_ip", "destination_ip", "user_id",
    "process_name", "command_line", "file_path",
)

EVENT = T.StructType(
    [T.StructField("timestamp", T.TimestampNTZType())]
    + [T.StructField(name, T.StringType()) for name in EVENT_TEXT_FIELDS]
    + [
        T.StructField("metadata", METADATA),
        T.StructField("quality_flags", T.ArrayType(T.StringType())),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

CLEANUP_LOG = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("rows_deleted", T.LongType()),
    T.StructField("cleanup_time", T.TimestampNTZType()),
    T.StructField("retention_days", T.IntegerType()),
])

MAPPING = T.StructType([
    T.StructField("original_value", T.BinaryType()),
    T.StructField("anonymized_value", T.StringType()),
    T.StructField("field_type", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("encrypted", T.BooleanType()),
])

AUDIT = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("vm_id", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("start", T.TimestampNTZType()),
    T.StructField("end", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("exit_code", T.IntegerType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
])

CHECK_RESULT = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("config_file", T.StringType()),
    T.StructField("summary", T.StructType([
        T.StructField(n, T.LongType()) for n in ("passed", "failed", "warnings", "total")
    ])),
    T.StructField("vm_ips", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tests", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
    ]))),
])
