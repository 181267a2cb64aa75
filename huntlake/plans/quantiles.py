"""Exact quantiles of large columns by rank bracketing, in two scans.

The first scan takes approximate quantiles a little below and above the wanted ones; their error is bounded, so the wanted ranks lie
between them. The second counts, per column, the rows below, between and above these brackets, and only the few values
inside a bracket are kept apart and sorted. What is shuffled is a small part of the rows, whatever their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from huntlake.plans.ordered import HOT_ROWS, Ordered
from huntlake.plans.sizes import local_rows

#: Approximate ranks are off by at most a 1/ACCURACY of the rows; brackets reach out three times as far.
ACCURACY, REACH = 10_000, 3


def _key(i: int) -> str:
    return f"_bracket_{i}"


def bracket_aggs(columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates to take in the first scan, together with others if wanted: rows and brackets per column."""
    reach = REACH / accuracy
    ends = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-reach, reach)]
    out = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        out += [F.percentile_approx(v, ends, accuracy).alias(_key(i)), F.count(v).alias(f"{_key(i)}_n")]
    return out


def _intervals(seen: Row, i: int) -> list[tuple[float, float]]:
    """Disjoint brackets of a column, in order."""
    ends, merged = seen[_key(i)] or [], []
    for lo, hi in sorted(zip(ends[::2], ends[1::2])):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def _region(v: Column, brackets: Sequence[tuple[float, float]]) -> Column:
    """0, 2, 4, … outside the brackets and 1, 3, 5, … inside."""
    out = None
    for i, (lo, hi) in enumerate(brackets):
        out = F.when(v < lo, 2 * i) if out is None else out.when(v < lo, 2 * i)
        out = out.when(v <= hi, 2 * i + 1)
    return F.lit(0) if out is None else out.otherwise(2 * len(brackets))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], seen: Row | None = None,
                    accuracy: int = ACCURACY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (column_name, p, q): quantiles with linear interpolation, NULLs left out; a column without values has no rows.
    ``seen`` is the row of ``bracket_aggs`` when the first scan was made already."""
    if seen is None:
        seen = df.agg(*bracket_aggs(columns, probs, accuracy)).first()
    cells = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        region = _region(v, _intervals(seen, i))
        cells.append(F.struct(F.lit(c).alias("column_name"), region.alias("region"), F.when(region % 2 == 1, v).alias("inside"), v.alias("v")))
    # one row per value inside a bracket, and one for all that lies between two brackets
    counts = (
        df.select(F.explode(F.array(*cells)).alias("e")).select("e.*").where(F.col("v").isNotNull())
        .groupBy("column_name", "region", "inside").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    wanted, many = [], 0
    for i, c in enumerate(columns):
        n = seen[f"{_key(i)}_n"]
        many = max(many, n * 2 * REACH * len(probs) // accuracy)
        for p in probs if n else ():
            pos = (n - 1) * float(p)
            wanted.append((c, float(p), int(pos), min(int(pos) + 1, n - 1), pos - int(pos)))
    if many > hot_rows:
        ranked = Ordered.slices(counts, ["column_name"], ["region", "inside"]).running_sum("upto", F.col("n")).df
    else:
        grow = Window.partitionBy("column_name").orderBy("region", "inside").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counts.withColumn("upto", F.sum("n").over(grow))
    # columns x probs rows
    ranks = F.broadcast(local_rows(df.sparkSession, wanted, "column_name string, p double, first long, second long, share double"))
    start = F.col("upto") - F.col("n")
    # of rows between brackets only the ends are known; no wanted rank lies further inside
    end = lambda rank: F.when(F.col(rank) == start, F.col("low")).when((F.col(rank) == F.col("upto") - 1) | (F.col("low") == F.col("high")), F.col("high"))
    at = lambda rank: F.max(F.when((F.col(rank) >= start) & (F.col(rank) < F.col("upto")), end(rank)))
    return (
        ranked.join(ranks, "column_name").where((F.col("second") >= start) & (F.col("first") < F.col("upto")))
        .groupBy("column_name", "p", "share").agg(at("first").alias("a"), at("second").alias("b"))
        .select("column_name", "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("q"))
    )

