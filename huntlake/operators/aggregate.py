"""Counts, series, profiles and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntlake.plans.quantiles import bracket_aggs, exact_quantiles
from huntlake.plans.sizes import local_rows


def hourly_profile(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Events per hour of day; hours without events are absent."""
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def daily_counts(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("n"))


def resample_hourly(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Events per hour from the first to the last bucket, empty hours as 0.

    Events are counted first. Each counted hour then fills the gap up to the next one; that window
    sees one row per hour, so one task for it is enough, and the events are read once.
    """
    counts = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")) \
        .agg(F.count(F.lit(1)).alias("n"))
    following = F.lead("hour").over(Window.orderBy("hour"))
    last = F.coalesce(following - F.expr("INTERVAL 1 HOUR"), F.col("hour"))
    filled = counts.withColumn("last", last).select(
        "hour", "n", F.explode(F.sequence("hour", "last", F.expr("INTERVAL 1 HOUR"))).alias("bucket"))
    return filled.select("bucket", F.when(F.col("bucket") == F.col("hour"), F.col("n")).otherwise(0).alias("n"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Dataframe-style counts: NULL is not a value. Ties are ordered by the value."""
    out = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy(F.desc("n"), column)
    return out.limit(top) if top else out


def group_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """SQL-style counts: NULL forms its own group."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column))
    return out.limit(top) if top else out


def group_size(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def user_profile(df: DataFrame, key: str = "user_id", counted: str = "event_type", distinct: str = "source_ip",
                 approximate: bool = False) -> DataFrame:
    """Non-NULL count and non-NULL distinct count per key. The exact form counts (key, value) pairs
    first, so a key with very many rows still spreads over tasks."""
    if approximate:
        return df.groupBy(key).agg(F.count(counted).alias("n_events"),
                                   F.approx_count_distinct(distinct).alias("n_distinct"))
    pairs = df.groupBy(key, distinct).agg(F.count(counted).alias("c"))
    return pairs.groupBy(key).agg(F.sum("c").alias("n_events"), F.count(distinct).alias("n_distinct"))


def describe_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column; quartiles are exact. Two scans of the columns; the first is made
    when this is called, since the second depends on it."""
    aggs, probs = [], (0.25, 0.5, 0.75)
    for c in columns:
        aggs += [F.count(c).alias(f"{c}|count"), F.avg(c).alias(f"{c}|mean"), F.stddev_samp(c).alias(f"{c}|std"),
                 F.min(c).cast("double").alias(f"{c}|min"), F.max(c).cast("double").alias(f"{c}|max")]
    seen = df.agg(*aggs, *bracket_aggs(columns, probs)).first()
    names = ("count", "mean", "std", "min", "max")
    # one row per column
    basic = F.broadcast(local_rows(df.sparkSession, [(c, *[seen[f"{c}|{s}"] for s in names]) for c in columns],
                                   "column_name string, count long, mean double, std double, min double, max double"))
    quart = (
        exact_quantiles(df, columns, probs, seen)
        .groupBy("column_name")
        .agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in zip(probs, ("q25", "q50", "q75"))])
    )
    return quart.join(basic, "column_name", "right").select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum falls into the last bin. Empty bins are absent."""
    lo = df.agg(F.min(column)).scalar()
    hi = df.agg(F.max(column)).scalar()
    v = F.col(column)
    # a single distinct value has no width: everything is bin 1
    number = F.when(lo == hi, F.lit(1).cast("long")).otherwise(
        F.least(F.call_function("width_bucket", v, lo, F.when(lo == hi, lo + 1).otherwise(hi), F.lit(bins)),
                F.lit(bins).cast("long"))
    )
    return df.where(v.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def check_summary(tests: DataFrame, *group: str) -> DataFrame:
    status = F.col("status")
    return tests.groupBy(*group).agg(
        F.count_if(status == "PASS").alias("passed"),
        F.count_if(status == "FAIL").alias("failed"),
        F.count_if(status == "WARN").alias("warnings"),
        F.count(F.lit(1)).alias("total"),
    )


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Operations and durations per user and status; seconds rounded to 3 places."""
    micros = F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end"))
    return audit.groupBy("user_id", "status").agg(
        F.count(F.lit(1)).alias("operations"),
        F.round(F.avg(micros) / 1e6, 3).alias("avg_seconds"),
        F.round(F.max(micros) / 1e6, 3).alias("max_seconds"),
    )
