"""Inputs and Arrow batches shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_ROWS = 1024
SLICE_BYTES = 8 << 20
CACHE_WORDS = 400_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text`` (NULL read as empty); every other column is left behind."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, whatever characters the name has."""
    return df["`" + name.replace("`", "``") + "`"]


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with a bounded number of rows and, single long rows aside, of bytes."""
    start, n = 0, batch.num_rows
    while start < n:
        rows = min(SLICE_ROWS, n - start)
        piece = batch.slice(start, rows)
        while rows > 1 and piece.column(text).nbytes > SLICE_BYTES:
            rows //= 2
            piece = batch.slice(start, rows)
        yield piece
        start += rows


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, text: str = "text") -> DataFrame:
    """``make()`` once per task gives a function from a slice of rows to columns of ``schema``;
    ``text`` is the column whose bytes a slice bounds."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        step = make()
        for batch in batches:
            for piece in slices(batch, text):
                out = step(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, schema)


class Cache(dict):
    """Remembers ``make(key)``; emptied when it holds ``limit`` keys, so its memory is bounded."""

    def __init__(self, make: Callable, limit: int = CACHE_WORDS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
