"""Custom file formats whose records span lines, as a Spark data source.

    spark.dataSource.register(CustomRecords)
    spark.read.format("custom_records").option("start", r"^== ").option("record", r"== (?P<id>\\d+)\\n(?P<body>.*)").load(folder)

A record begins at a line that ``start`` matches and goes on to the next such line. Files are cut into ranges of bytes; a record
belongs to the range its first byte is in, so every record is read once however the cuts fall. A partition is one range, or, where
there are more than ``TASKS`` of them, several up to ``TASK_BYTES``. A task holds one batch of records. Paths are opened by pyarrow: local and shared folders, and the object stores it knows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

RANGE_BYTES, BATCH_RECORDS, CHUNK = 64 << 20, 5_000, 1 << 20
#: Ranges share partitions beyond so many, and a partition takes no more of them from so many bytes on.
TASKS, TASK_BYTES = 256, 64 << 20


@dataclass
class FileRanges(InputPartition):
    """(path, begin, end) of each range."""

    ranges: list[tuple[str, int, int]]


def together(ranges: list[tuple[str, int, int]]) -> list[FileRanges]:
    """Ranges in order, in partitions of even size."""
    share = min(sum(end - begin for _, begin, end in ranges) / TASKS, TASK_BYTES)
    out, size = [], share
    for x in ranges:
        if size >= share:
            out.append(FileRanges([]))
            size = 0
        out[-1].ranges.append(x)
        size += x[2] - x[1]
    return out


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _lines(stream, at: int, first: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line with its end) from a stream that stands at ``at``; ``first`` bytes are read at first, so that little is read beyond a
    small range."""
    rest, want = b"", first
    while chunk := stream.read(want):
        want = min(2 * want, CHUNK)
        parts = (rest + chunk).split(b"\n")
        rest = parts.pop()
        for part in parts:
            yield at, part + b"\n"
            at += len(part) + 1
    if rest:
        yield at, rest


def records(path: str, begin: int, end: int, start: re.Pattern) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records whose first byte is in the range."""
    fs, name = _opened(path)
    with fs.open_input_file(name) as stream:
        # a line that begins at the border belongs to this range: look from the byte before on
        at = max(begin - 1, 0)
        stream.seek(at)
        lines = _lines(stream, at, min(end - at + 4096, CHUNK))
        if begin:
            next(lines, None)
        first, held = 0, None
        for offset, line in lines:
            if start.search(line.rstrip(b"\r\n")):
                if held is not None:
                    yield first, b"".join(held)
                if offset >= end:
                    return
                first, held = offset, [line]
            elif held is not None:
                held.append(line)
            elif offset >= end:
                return
        if held is not None:
            yield first, b"".join(held)


class CustomRecords(DataSource):
    """Options: ``start`` (pattern of a record's first line), ``record`` (pattern of a whole record; its named groups are the columns, all text),
    ``rangeBytes``, ``encoding``. Columns ``file``, ``offset`` and ``raw`` (only of records that ``record`` does not match) are added. Empty
    groups are NULL. Lines before the first record of a file are left out."""

    @classmethod
    def name(cls) -> str:
        return "custom_records"

    def _groups(self) -> list[str]:
        names = re.compile(self.options["record"], re.S).groupindex
        return sorted(names, key=names.get)

    def schema(self) -> StructType:
        text = [StructField(n, StringType()) for n in [*self._groups(), "raw", "file"]]
        return StructType([*text, StructField("offset", LongType())])

    def reader(self, schema: StructType) -> "RecordReader":
        return RecordReader(dict(self.options), self._groups())


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, groups: list[str]):
        self.path, self.start, self.record = options["path"], options["start"], options["record"]
        self.size = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.encoding, self.groups = options.get("encoding", "utf-8"), groups

    def partitions(self) -> list[FileRanges]:
        fs, root = _opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file]
        files = [f for f in files if f.size and not f.base_name.startswith(("_", "."))]
        prefix = self.path[: len(self.path) - len(root)] if "://" in self.path and self.path.endswith(root) else ""
        return together([(prefix + f.path, at, min(at + self.size, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.size)])

    def read(self, partition: FileRanges) -> Iterator[pa.RecordBatch]:
        start, record = re.compile(self.start.encode(self.encoding)), re.compile(self.record, re.S)
        held: list[list] = []
        for path, offset, data in ((x[0], *found) for x in partition.ranges for found in records(*x, start)):
            text = data.decode(self.encoding, errors="replace").rstrip("\r\n")
            found = record.fullmatch(text)
            values = [found[g] or None for g in self.groups] if found else [None] * len(self.groups)
            held.append([*values, None if found else text, path, offset])
            if len(held) >= BATCH_RECORDS:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        names = [*self.groups, "raw", "file"]
        arrays = [pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))] + [pa.array([r[-1] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, "offset"])


def scan_custom(spark, path: str, start: str, record: str, **options: str):
    """Records of a custom format, see ``CustomRecords``."""
    spark.dataSource.register(CustomRecords)
    reader = spark.read.format("custom_records").option("start", start).option("record", record)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)
