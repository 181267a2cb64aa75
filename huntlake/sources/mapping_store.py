"""Stored mappings of masked values: a bucketed table, and per bucket a filter that knows which values cannot be in it.

A batch is made distinct and dealt to the buckets. What a bucket's filter does not know is new for certain and is not
looked up at all; the rest is looked up exactly, in a join that the stored side enters as its buckets lie, without a shuffle. So
a batch costs its own size, and reading the buckets only for values that are probably stored.

The filters are written before the rows. A call that is killed in between leaves filters that know too much, which costs
look-ups but adds no value twice. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.operators.privacy import encrypt, mask_by_type
from huntlake.plans.sizes import local_rows
from huntlake.session import pin
from huntlake.sources.files import Files

#: Values of the first filter of a bucket (each further one holds twice as many), bits for each, and hash functions.
FIRST, BITS, HASHES = 4096, 12, 8
FILTER = "bucket int, layer int, n long, bits binary"
_FILTER = pa.schema([("bucket", pa.int32()), ("layer", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])
KEY = ["anonymized_value", "field_type"]


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """Bits of each 64-bit hash, a row per value."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(size)).astype(np.int64)


class Filter:
    """Which values of a bucket are stored, perhaps with others: Bloom filters that double in size as they fill up."""

    def __init__(self, layers: list[tuple[int, bytes]]):
        self.layers = [(n, np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)) for n, bits in layers]

    def knows(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for _, bits in self.layers:
            out |= bits[_places(h, len(bits))].all(axis=1)
        return out

    def add(self, h: np.ndarray) -> None:
        while len(h):
            full = FIRST << max(len(self.layers) - 1, 0)
            if not self.layers or self.layers[-1][0] >= full:
                full = FIRST << len(self.layers)
                self.layers.append((0, np.zeros(full * BITS, bool)))
            n, bits = self.layers[-1]
            part, h = h[: full - n], h[full - n:]
            bits[_places(part, len(bits)).ravel()] = True
            self.layers[-1] = (n + len(part), bits)

    def rows(self) -> list[tuple[int, bytes]]:
        return [(n, np.packbits(bits).tobytes()) for n, bits in self.layers]


def _filter_of(table: pa.Table) -> Filter:
    rows = sorted(zip(table.column("layer").to_pylist(), table.column("n").to_pylist(), table.column("bits").to_pylist()))
    return Filter([(n, bits) for _, n, bits in rows])


def _known(values: pa.Table, filters: pa.Table) -> pa.Table:
    h = values.column("h").to_numpy()
    return values.append_column("known", pa.array(_filter_of(filters).knows(h) if len(h) else [], pa.bool_()))


def _grown(values: pa.Table, filters: pa.Table) -> pa.Table:
    held = _filter_of(filters)
    held.add(values.column("h").to_numpy())
    bucket = (values if len(values) else filters).column("bucket")[0].as_py()
    rows = held.rows()
    return pa.table([pa.array([bucket] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array([n for n, _ in rows], pa.int64()),
                     pa.array([b for _, b in rows], pa.binary())], schema=_FILTER)


@dataclass
class MappingStore:
    """Table ``name`` with its files under ``path``. The number of buckets is fixed when the table is made; take so many
    that a bucket with its filter fits a task: about one per ten million values, and no fewer than shuffle partitions."""

    spark: SparkSession
    name: str
    path: str
    buckets: int = 64

    def create(self) -> "MappingStore":
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (original_value BINARY, anonymized_value STRING, field_type STRING, created_at TIMESTAMP_NTZ,"
            f" encrypted BOOLEAN) USING parquet CLUSTERED BY (anonymized_value, field_type) INTO {int(self.buckets)} BUCKETS LOCATION '{self.path}/rows'")
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def _versions(self) -> list[str]:
        files = Files(self.spark)
        return [v for v in files.names(f"{self.path}/filters") if files.exists(f"{self.path}/filters/{v}/_SUCCESS")]

    def _filters(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], FILTER)
        return self.spark.read.schema(FILTER).parquet(f"{self.path}/filters/{versions[-1]}")

    def unknown(self, values: DataFrame) -> DataFrame:
        """``values`` (with the columns of ``KEY``) that are not stored. Values the filters do not know are not looked up."""
        dealt = values.withColumns({"bucket": F.pmod(F.hash(*KEY), F.lit(self.buckets)), "h": F.xxhash64(*KEY)})
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", known boolean"
        marked = pin(dealt.groupBy("bucket").cogroup(self._filters().groupBy("bucket")).applyInArrow(_known, schema))
        looked_up = marked.where("known").join(self.read().select(*KEY), KEY, "left_anti")
        return marked.where("NOT known").unionByName(looked_up).drop("known")

    def add(self, values: DataFrame, salt: str, key: str, as_of: datetime | str) -> DataFrame:
        """Store what is new of ``values`` (original, field_type) and report (batch_values, added). NULL values have no mapping."""
        given = values.where(F.col("original").isNotNull()).select("original", "field_type").distinct()
        # two originals with one mask would be one mapping; the least is stored
        masked = given.withColumn("anonymized_value", mask_by_type(F.col("original"), F.col("field_type"), salt)) \
            .groupBy(*KEY).agg(F.min("original").alias("original"))
        masked = pin(masked)
        fresh = pin(self.unknown(masked))
        added = fresh.count()
        if added:
            files, versions = Files(self.spark), self._versions()
            number = 1 + int(versions[-1]) if versions else 1
            grown = fresh.select("bucket", "h").groupBy("bucket").cogroup(self._filters().groupBy("bucket")).applyInArrow(_grown, FILTER)
            grown.write.mode("overwrite").parquet(f"{self.path}/filters/{number:08d}")
            rows = fresh.select(encrypt(F.col("original"), key).alias("original_value"), *KEY, F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
                                F.lit(True).alias("encrypted"))
            # by bucket, so that a task writes its own buckets' files and not one file for each
            rows.repartition(self.buckets, *KEY).write.insertInto(self.name)
            for v in versions:
                files.delete(f"{self.path}/filters/{v}")
        return local_rows(self.spark, [(masked.count(), added)], "batch_values long, added long")
