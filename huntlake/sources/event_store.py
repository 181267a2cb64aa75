"""Stored events whose time filters reach folders and files.

Events lie in one folder per day. Beside them a table says of every file which times it holds, so a filter of an hour reads the files of
that hour, also where a day has many. Files that the table does not know yet are read as well; files that are gone are
left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.operators.filters import between
from huntlake.sources.files import Files
from huntlake.sources.sinks import write_events

TIMES = T.StructType([
    T.StructField("day", T.StringType()), T.StructField("file", T.StringType()), T.StructField("least", T.TimestampNTZType()),
    T.StructField("greatest", T.TimestampNTZType()), T.StructField("rows", T.LongType()),
])


def _time(value: datetime | str) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


@dataclass
class EventStore:
    """``schema`` is that of the events as written, without the day."""

    spark: SparkSession
    path: str
    schema: T.StructType
    ts: str = "timestamp"
    day: str = "event_date"

    @property
    def times_path(self) -> str:
        return f"{self.path.rstrip('/')}-times"

    def _full(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(self.day, T.DateType())])

    def append(self, events: DataFrame, files: int | None = None) -> None:
        """Store events and enter their files into the table of times."""
        write_events(events.select(*self.schema.names), self.path, self.ts, self.day, files)
        self.refresh()

    def read(self) -> DataFrame:
        return self.spark.read.schema(self._full()).parquet(self.path)

    def times(self) -> DataFrame:
        """(day, file, least, greatest, rows) of the files known."""
        if not Files(self.spark).exists(self.times_path):
            return self.spark.createDataFrame([], TIMES)
        return self.spark.read.schema(TIMES).parquet(self.times_path)

    def _days(self) -> list[str]:
        mark = f"{self.day}="
        return [n.removeprefix(mark) for n in Files(self.spark).names(self.path) if n.startswith(mark)]

    def _files(self, day: str) -> list[str]:
        return [n for n in Files(self.spark).names(f"{self.path}/{self.day}={day}") if not n.startswith(("_", "."))]

    def refresh(self) -> int:
        """Enter files that are not in the table of times yet; returns how many. Only they are read, and of them only the time."""
        known: dict[str, set[str]] = {}
        for r in self.times().select("day", "file").collect():  # names only, as Spark lists them itself
            known.setdefault(r.day, set()).add(r.file)
        new = [f"{self.path}/{self.day}={d}/{f}" for d in self._days() for f in self._files(d) if f not in known.get(d, ())]
        if new:
            self._times_of(new).coalesce(1 + len(new) // 10_000).write.mode("append").parquet(self.times_path)
        return len(new)

    def _times_of(self, paths: Sequence[str]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        where = F.col("_metadata.file_path")
        return rows.groupBy(
            F.regexp_extract(where, f"{self.day}=([^/]*)/[^/]*$", 1).alias("day"), F.col("_metadata.file_name").alias("file"),
        ).agg(F.min(self.ts).cast("timestamp_ntz").alias("least"), F.max(self.ts).cast("timestamp_ntz").alias("greatest"), F.count(F.lit(1)).alias("rows"))

    def files_between(self, start: datetime, end: datetime) -> list[str]:
        """Files that may hold events of the half-open range."""
        days = {d for d in self._days() if d[:1].isdigit() and start.date() <= date.fromisoformat(d) <= (end - timedelta(microseconds=1)).date()}
        rows = self.times().where(F.col("day").isin(sorted(days))).collect() if days else []  # a row per file of these days
        out_of_range = {(r.day, r.file) for r in rows if r.least is None or r.least >= end or r.greatest < start}
        return [f"{self.path}/{self.day}={d}/{f}" for d in sorted(days) for f in self._files(d) if (d, f) not in out_of_range]

    def between(self, start: datetime | str, end: datetime | str) -> DataFrame:
        """Events of the half-open range, from the files that can have any; the day and the time are filters as well."""
        start, end = _time(start), _time(end)
        chosen = self.files_between(start, end)
        if not chosen:
            return self.spark.createDataFrame([], self._full())
        rows = self.spark.read.schema(self._full()).option("basePath", self.path).parquet(*chosen)
        return between(rows, self.ts, start, end, self.day)

    def recent(self, as_of: datetime | str, hours: int = 24) -> DataFrame:
        """The ``hours`` before ``as_of`` and what is later, newest first."""
        return self.between(_time(as_of) - timedelta(hours=hours), datetime(9999, 12, 31)).orderBy(F.desc(self.ts))
