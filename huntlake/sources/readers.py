"""Reading raw and stored data. Schemas are always given, never inferred."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from huntlake.functions.common import MARK
from huntlake.functions.parse import parse_winevent
from huntlake.plans.sizes import local_rows

CORRUPT = "_corrupt"


def _permissive(schema: StructType) -> StructType:
    return schema if CORRUPT in schema.names else StructType([*schema.fields, StructField(CORRUPT, StringType())])


def _reader(spark: SparkSession, live: bool):
    return spark.readStream if live else spark.read


def scan_json(spark: SparkSession, path: str, schema: StructType, live: bool = False) -> DataFrame:
    """JSON lines; unreadable lines are kept in ``_corrupt``."""
    return (
        _reader(spark, live).schema(_permissive(schema))
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )


def _header(spark: SparkSession, path: str) -> list[str] | None:
    """Names in the first line of the first file; None when there is no line."""
    first = spark.read.option("wholetext", False).text(path).limit(1).collect()
    return next(csv.reader([first[0].value])) if first else None


def scan_csv(spark: SparkSession, path: str, schema: StructType, live: bool = False, multiline: bool = True) -> DataFrame:
    """CSV with a header; lines that do not fit the schema are kept in ``_corrupt``.

    Columns are found by their names: the header may have another order, more columns, or lack some (NULL then). All files of a
    source must have the same header, else the read fails. Values may hold line breaks; a file is then read by one
    task. ``multiline=False`` cuts files into splits, for sources known to have none. A stream cannot look ahead, so its
    header must be that of ``schema``."""
    names = None if live else _header(spark, path)
    kinds = {f.name: f for f in schema.fields}
    found = schema if names is None else StructType([kinds.get(n, StructField(n, StringType())) for n in names])
    rows = (
        _reader(spark, live).schema(_permissive(found)).option("header", True).option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", multiline).option("enforceSchema", False).option("emptyValue", MARK).csv(path)
    )

    def column(field: StructField) -> Column:
        if field.name not in found.names and field.name != CORRUPT:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(f"`{field.name}`")
        # "" is an empty text, nothing at all is NULL
        return F.when(value == MARK, "").otherwise(value).alias(field.name) if isinstance(field.dataType, StringType) else value

    return rows.select(*[column(f) for f in _permissive(schema)])


def scan_lines(spark: SparkSession, path: str, live: bool = False) -> DataFrame:
    """Text lines as ``line``: syslog, audit and database logs, custom formats."""
    return _reader(spark, live).text(path).withColumnRenamed("value", "line")


def scan_winevents(spark: SparkSession, path: str, live: bool = False) -> DataFrame:
    """Windows events exported as XML, one ``<Event>`` element per line."""
    return parse_winevent(scan_lines(spark, path, live)).drop("line")


def scan_winevent_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole XML exports, where an event spans lines."""
    return spark.read.format("xml").option("rowTag", "Event").schema(schema).load(path)


def scan_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               where=None, schema: StructType | None = None, live: bool = False) -> DataFrame:
    """A stored table. Column and row selection reach the Parquet scan."""
    reader = _reader(spark, live)
    df = (reader.schema(schema) if schema else reader).parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Name frames so that hunts can be written as SQL text."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def scan_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower, upper,
              partitions: int, **options: str) -> DataFrame:
    """A database table, read in ``partitions`` ranges of ``partition_column``."""
    return (
        spark.read.format("jdbc").options(**options)
        .option("url", url).option("dbtable", table).option("partitionColumn", partition_column)
        .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
        .load()
    )


@dataclass
class Source:
    """One landing place: format is json, csv, lines, winevent or parquet."""

    name: str
    path: str
    fmt: str
    schema: StructType | None = None
    options: dict = field(default_factory=dict)


def read_source(spark: SparkSession, source: Source, live: bool = False) -> DataFrame:
    if source.fmt == "json":
        return scan_json(spark, source.path, source.schema, live)
    if source.fmt == "csv":
        return scan_csv(spark, source.path, source.schema, live)
    if source.fmt == "lines":
        return scan_lines(spark, source.path, live)
    if source.fmt == "winevent":
        return scan_winevents(spark, source.path, live)
    if source.fmt == "parquet":
        return scan_table(spark, source.path, schema=source.schema, live=live)
    raise ValueError(f"unknown format {source.fmt!r}")


def collect_sources(spark: SparkSession, sources: Sequence[Source]) -> tuple[DataFrame | None, DataFrame]:
    """All sources that can be opened as one frame, and a status row per source. A source that
    fails does not stop the others."""
    frames, status = [], []
    for source in sources:
        try:
            frames.append(read_source(spark, source).withColumn("collected_from", F.lit(source.name)))
            status.append((source.name, "ok", None))
        except (AnalysisException, ValueError) as exc:
            status.append((source.name, "failed", type(exc).__name__))
    merged = None
    for frame in frames:
        merged = frame if merged is None else merged.unionByName(frame, allowMissingColumns=True)
    report = local_rows(spark, status, "source string, status string, error string")  # one row per source
    return merged, report
