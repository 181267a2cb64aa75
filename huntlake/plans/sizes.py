"""Broadcast only what was counted."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, nested values as JSON, others eight."""
    out = F.lit(16).cast("long")
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            size = F.octet_length(F.to_json(F.struct(c.alias("v"))))
        else:
            size = F.lit(8)
        out = out + F.coalesce(size, F.lit(0)).cast("long")
    return out


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` hinted for broadcast when it has at most ``max_rows`` rows and about ``max_bytes`` bytes, else ``df`` as it is, so
    that the join is planned as a shuffle join with adaptive skew handling."""
    seen, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if seen <= max_rows and size <= max_bytes else df


def local_rows(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    """A frame from a few driver-side rows. It is planned as a local relation, so its size is known."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], type=to_arrow_type(f.dataType)) for i, f in enumerate(schema)]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)
