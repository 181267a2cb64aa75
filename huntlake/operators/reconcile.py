"""Which rows of a copy differ, found by digests over a tree of key ranges.

The keys of both tables are cut into ranges, each range has a digest on either side, and only ranges whose digests differ are read
again: cut anew, until they are small, and then compared row by row. A table without differences is read once, and one changed row costs
one small range more. Tables stored in the order of the key are pruned by their files' statistics, since ranges are plain
comparisons of the key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.operators.compare import canonical_json, row_digest
from huntlake.plans.sizes import local_rows

#: Ranges that a range is cut into, and rows up to which a range is compared row by row.
FAN, LEAF_ROWS = 1024, 50_000


@dataclass(frozen=True)
class Range:
    """Keys from ``lo`` up to, not including, ``hi``, as whole numbers; ``None`` for the rows without a key."""

    lo: int | None
    hi: int | None


class _Key:
    """A key column and its values as whole numbers."""

    def __init__(self, df: DataFrame, name: str):
        self.name, self.kind = name, df.schema[name].dataType
        if not isinstance(self.kind, (T.IntegralType, T.DateType, T.TimestampNTZType, T.TimestampType)):
            raise ValueError(f"{name}: the key must be a whole number, a date or a time")

    def number(self) -> Column:
        key = F.col(self.name)
        if isinstance(self.kind, T.DateType):
            return F.unix_date(key).cast("long")
        if isinstance(self.kind, (T.TimestampNTZType, T.TimestampType)):
            return F.unix_micros(key.cast("timestamp"))
        return key.cast("long")

    def literal(self, n: int) -> Column:
        if isinstance(self.kind, T.DateType):
            return F.lit(date(1970, 1, 1) + timedelta(days=n))
        if isinstance(self.kind, (T.TimestampNTZType, T.TimestampType)):
            return F.lit(datetime(1970, 1, 1) + timedelta(microseconds=n)).cast(self.kind)
        return F.lit(n).cast(self.kind) if -(1 << 63) <= n < 1 << 63 else F.lit(n)

    def within(self, ranges: Sequence[Range]) -> Column:
        """Rows in any of the ranges; neighbours are joined first, so that the condition stays short."""
        out = F.lit(False)
        joined: list[list[int]] = []
        for r in sorted((r for r in ranges if r.lo is not None), key=lambda r: r.lo):
            if joined and joined[-1][1] == r.lo:
                joined[-1][1] = r.hi
            else:
                joined.append([r.lo, r.hi])
        for lo, hi in joined:
            out = out | ((F.col(self.name) >= self.literal(lo)) & (F.col(self.name) <= self.literal(hi - 1)))
        return out | F.col(self.name).isNull() if any(r.lo is None for r in ranges) else out


def _cut(r: Range, fan: int) -> int:
    """Width of the parts of a range."""
    return -(-(r.hi - r.lo) // fan)


def _digests(df: DataFrame, key: _Key, columns: Sequence[str], ranges: Sequence[Range], fan: int, side: str) -> DataFrame:
    """Rows and digest of each part of each range: (range, part, rows, digest). Sums over rows, so they combine before the shuffle."""
    number = key.number()
    which, part = F.lit(-1), F.lit(0).cast("long")
    for i, r in enumerate(ranges):
        inside = number.isNull() if r.lo is None else (number >= r.lo) & (number < r.hi)
        which = F.when(inside, i).otherwise(which)
        if r.lo is not None:
            part = F.when(inside, F.floor((number - r.lo) / F.lit(_cut(r, fan)).cast("decimal(20,0)")).cast("long")).otherwise(part)
    return df.groupBy(which.alias("range"), part.alias("part")).agg(
        F.count(F.lit(1)).alias(f"{side}_rows"), row_digest(canonical_json(columns)).alias(f"{side}_digest"))


def _differing(source: DataFrame, copy: DataFrame, key: _Key, columns: Sequence[str], ranges: list[Range], fan: int) -> list[tuple[Range, int]]:
    """The parts that differ, with the rows of the larger side. At most ``fan`` per range, of which there are at most ``fan``."""
    a = _digests(source, key, columns, ranges, fan, "source")
    b = _digests(copy, key, columns, ranges, fan, "copy")
    rows = a.join(b, ["range", "part"], "full_outer").where(~F.col("source_digest").eqNullSafe(F.col("copy_digest"))).select(
        "range", "part", F.greatest(F.coalesce("source_rows", F.lit(0)), F.coalesce("copy_rows", F.lit(0))).alias("n")).collect()
    out = []
    for row in rows:
        r = ranges[row["range"]]
        if r.lo is None:
            out.append((r, 0))  # rows without a key cannot be cut further
        else:
            lo = r.lo + row.part * _cut(r, fan)
            out.append((Range(lo, min(lo + _cut(r, fan), r.hi)), row.n))
    return out


def differing_ranges(source: DataFrame, copy: DataFrame, key: str, columns: Sequence[str] | None = None, fan: int = FAN,
                     leaf_rows: int = LEAF_ROWS) -> list[Range]:
    """Small key ranges that hold all differences. When more than ``fan`` ranges differ they are not cut further."""
    columns = list(columns or source.columns)
    k = _Key(source, key)
    ends = source.select(k.number().alias("n")).union(copy.select(_Key(copy, key).number())).agg(F.min("n"), F.max("n")).first()
    todo = [Range(None, None)] + ([Range(ends[0], ends[1] + 1)] if ends[0] is not None else [])
    done, first = [], True
    while todo:
        near = [source, copy] if first else [df.where(k.within(todo)) for df in (source, copy)]
        found = _differing(*near, k, columns, todo, fan)
        large = [(r, n) for r, n in found if n > leaf_rows and r.lo is not None and r.hi - r.lo > 1]
        small = [r for r, n in found if (r, n) not in large]
        done, todo, first = done + small, [r for r, _ in large], False
        if len(todo) > fan // 8:  # so many conditions cost more than reading the rows
            return done + todo
    return done


def reconcile_ranges(source: DataFrame, copy: DataFrame, key: str, columns: Sequence[str] | None = None, fan: int = FAN,
                     leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(key, status, source_rows, copy_rows) of each key whose rows differ: ``missing`` from the copy, ``extra`` in it, or ``changed``.
    ``key`` is a whole number, a date or a time and need not be unique: rows of one key are compared as a bag. Rows
    without a key are compared as one key, NULL. Both sides need ``columns`` (by default those of ``source``)."""
    columns = list(columns or source.columns)
    ranges = differing_ranges(source, copy, key, columns, fan, leaf_rows)
    k, out = _Key(source, key), T.StructType([
        T.StructField(key, source.schema[key].dataType), T.StructField("status", T.StringType()),
        T.StructField("source_rows", T.LongType()), T.StructField("copy_rows", T.LongType())])
    if not ranges:
        return local_rows(source.sparkSession, [], out)

    def side(df: DataFrame, name: str) -> DataFrame:
        near = df.where(k.within(ranges)) if _few(ranges) else df
        return near.groupBy(F.col(key).alias("_key")).agg(
            F.count(F.lit(1)).alias(f"{name}_rows"), row_digest(canonical_json(columns)).alias(f"{name}_digest"))

    a, b = side(source, "source"), side(copy, "copy").withColumnRenamed("_key", "_other")
    both = a.join(b, F.col("_key").eqNullSafe(F.col("_other")), "full_outer")
    status = F.when(F.col("copy_rows").isNull(), "missing").when(F.col("source_rows").isNull(), "extra").otherwise("changed")
    zero = F.lit(0).cast("long")
    return both.where(~F.col("source_digest").eqNullSafe(F.col("copy_digest"))).select(
        F.coalesce("_key", "_other").alias(key), status.alias("status"), F.coalesce("source_rows", zero).alias("source_rows"),
        F.coalesce("copy_rows", zero).alias("copy_rows"))


def _few(ranges: Sequence[Range]) -> bool:
    """Whether the ranges join up to a condition that is cheaper than reading all rows."""
    known = sorted((r.lo, r.hi) for r in ranges if r.lo is not None)
    return sum(1 for x, y in zip(known, known[1:]) if x[1] != y[0]) < FAN // 8
