"""Order-dependent work per key (previous row, running total, last value seen) without
letting one key grow into one task.

Keys of ordinary size use plain window functions: one shuffle on the key. Keys above a row
limit are cut by a range partitioning over (key, order) into slices of even size, however the
rows are spread over keys and time. Each slice is processed alone; what it needs from the
slices before it is carried in from a per-slice summary. A slice continues at most one key
from its predecessor, so the carry table has at most one row per slice and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntlake.plans.sizes import local_rows
from huntlake.session import pin

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 20_000
_SLICE = "_slice"


def hot_key_table(df: DataFrame, key: Sequence[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    A hot key also holds more than 1/MAX_HOT_KEYS of all rows, so there are fewer than
    MAX_HOT_KEYS of them whatever the data looks like; that bounds the collect and every
    broadcast made from it.
    """
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    floor = F.floor(counts.agg(F.sum("_rows")).scalar() / MAX_HOT_KEYS)
    rows = (
        counts.where(F.col("_rows") > F.greatest(F.lit(limit).cast("long"), floor))
        .select(*key)
        .collect()
    )
    if not rows:
        return None
    return local_rows(df.sparkSession, rows, df.select(*key).schema)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for name in names:
        cond = cond & left[name].eqNullSafe(right[name])
    return cond


class Ordered:
    """Rows in a fixed order inside each key. ``order`` must be total within a key."""

    def __init__(self, df: DataFrame, key: Sequence[str], order: Sequence[str], sliced: bool = False):
        self.df, self.key, self.order, self.sliced = df, list(key), list(order), sliced

    @classmethod
    def slices(cls, df: DataFrame, key: Sequence[str], order: Sequence[str], parts: int | None = None) -> "Ordered":
        spark = df.sparkSession
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = df.repartitionByRange(parts, *key, *order).withColumn(_SLICE, F.spark_partition_id())
        # range bounds come from sampling; pinning keeps a row in the same slice for every later use
        return cls(pin(ranged), key, order, sliced=True)

    def with_df(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.key, self.order, self.sliced)

    def _window(self):
        part = [_SLICE, *self.key] if self.sliced else self.key
        return Window.partitionBy(*part).orderBy(*self.order)

    def _carry(self, summary: DataFrame, value: Column, out: str) -> DataFrame:
        """Join ``value``, computed over the earlier slices of the same key, onto every row."""
        earlier = Window.partitionBy(*self.key).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        first_of_key = F.row_number().over(Window.partitionBy(*self.key).orderBy(_SLICE)) == 1
        carried = (
            summary.withColumn(out, value.over(earlier))
            .withColumn("_first", first_of_key)
            .where(~F.col("_first"))
            .select(F.col(_SLICE).alias("_cs"), *[F.col(k).alias(f"_c_{k}") for k in self.key], out)
        )
        cond = F.col(_SLICE) == F.col("_cs")
        for k in self.key:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
        # at most one continued key per slice, see the module text
        return self.df.join(F.broadcast(carried), cond, "left").drop("_cs", *[f"_c_{k}" for k in self.key])

    def previous(self, **exprs: Column) -> "Ordered":
        """Each expression as it was on the row before, NULL on the first row of a key."""
        names = list(exprs)
        if not self.sliced:
            w = self._window()
            return self.with_df(self.df.withColumns({n: F.lag(exprs[n]).over(w) for n in names}))
        packed = F.struct(*[exprs[n].alias(n) for n in names])
        pos = F.struct(*self.order)
        tail = self.df.groupBy(_SLICE, *self.key).agg(F.max_by(packed, pos).alias("_tail"))
        df = self._carry(tail, F.last("_tail"), "_in")
        inside = F.coalesce(F.lag(packed).over(self._window()), F.col("_in"))
        df = df.withColumn("_prev", inside)
        return self.with_df(df.withColumns({n: F.col(f"_prev.{n}") for n in names}).drop("_in", "_prev"))

    def running_sum(self, out: str, weight: Column) -> "Ordered":
        """Sum of ``weight`` from the first row of the key up to and including this row."""
        grow = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.sliced:
            return self.with_df(self.df.withColumn(out, F.sum(weight).over(grow)))
        total = self.df.groupBy(_SLICE, *self.key).agg(F.sum(weight).alias("_total"))
        df = self._carry(total, F.sum("_total"), "_in")
        df = df.withColumn(out, F.sum(weight).over(grow) + F.coalesce("_in", F.lit(0))).drop("_in")
        return self.with_df(df)

    def last_seen(self, out: str, value: Column) -> "Ordered":
        """The latest non-NULL ``value`` at or before this row."""
        grow = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.sliced:
            return self.with_df(self.df.withColumn(out, F.last(value, ignorenulls=True).over(grow)))
        pos = F.when(value.isNotNull(), F.struct(*self.order))
        tail = self.df.groupBy(_SLICE, *self.key).agg(F.max_by(value, pos).alias("_tail"))
        df = self._carry(tail, F.last("_tail", ignorenulls=True), "_in")
        inside = F.last(value, ignorenulls=True).over(grow)
        return self.with_df(df.withColumn(out, F.coalesce(inside, F.col("_in"))).drop("_in"))


def by_key(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    step: Callable[[Ordered], DataFrame],
    hot_rows: int = HOT_ROWS,
    hot: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Run ``step`` over ordinary keys and, when there are hot keys, over their slices (or ``hot``
    over their rows, for operators with a method of their own)."""
    table = hot_key_table(df, key, hot_rows)
    if table is None:
        return step(Ordered(df, key, order))
    table = F.broadcast(table)  # fewer than MAX_HOT_KEYS rows
    cold_df = df.join(table, _same(df, table, key), "left_anti")
    hot_df = df.join(table, _same(df, table, key), "left_semi")
    sliced = hot(hot_df) if hot else step(Ordered.slices(hot_df, key, order)).drop(_SLICE)
    return step(Ordered(cold_df, key, order)).unionByName(sliced)
