"""Projections, filters and top-k queries over events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between(df: DataFrame, ts: str, start, end, partition_date: str | None = None) -> DataFrame:
    """Half-open range. Name the date partition column to prune folders as well."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    out = df.where((F.col(ts) >= lo) & (F.col(ts) < hi))
    if partition_date:
        out = out.where((F.col(partition_date) >= F.to_date(lo)) & (F.col(partition_date) <= F.to_date(hi)))
    return out


def contains_like(column: Column, pattern: str, ignore_case: bool = False) -> Column:
    """LIKE is case-sensitive unless asked otherwise."""
    return column.ilike(pattern) if ignore_case else column.like(pattern)


def recent(df: DataFrame, ts: str, as_of, hours: int = 24, partition_date: str | None = None) -> DataFrame:
    """The last ``hours`` before ``as_of``, newest first. Name the date partition column to prune folders as well."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    if partition_date:
        df = df.where(F.col(partition_date) >= F.to_date(start))
    return df.where(F.col(ts) >= start).orderBy(F.desc(ts))


def where_all(df: DataFrame, **equals) -> DataFrame:
    """Equality filters joined by AND; None means no filter."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def allowed(df: DataFrame, column: str, allow: DataFrame, key: str, enabled: str = "enabled",
            override: Sequence[str] | None = None) -> DataFrame:
    """Rows whose value is allowed: the explicit list when there is one, else the enabled entries."""
    if override is not None:
        return df.where(F.col(column).isin(list(override)))
    names = allow.where(F.col(enabled)).select(F.col(key).alias(column))
    return df.join(names, column, "left_semi")


def latest(df: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    """The newest ``n`` rows."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def latest_per_group(df: DataFrame, group: str, ts: str, tie: str) -> DataFrame:
    """The newest row of each group, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c != group]
    best = F.max_by(F.struct(*rest), F.struct(ts, tie))
    return df.groupBy(group).agg(best.alias("r")).select(group, "r.*")


def union_names(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    return a.select(name).union(b.select(name)).distinct().orderBy(name)
