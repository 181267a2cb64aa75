"""Differing rows are found through key ranges, and only those ranges are read again."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from huntlake.operators import reconcile as V
from huntlake.session import scratch_path


def found(source, copy, key="k", **options):
    return sorted((tuple(r) for r in V.reconcile_ranges(source, copy, key, **options).collect()), key=repr)


def by_force(source, copy):
    def bags(rows):
        out = {}
        for k, *rest in rows:
            out.setdefault(k, []).append(repr(rest))
        return {k: sorted(v) for k, v in out.items()}
    a, b = bags(source), bags(copy)
    status = lambda k: "missing" if k not in b else "extra" if k not in a else "changed"
    return sorted(((k, status(k), len(a.get(k, [])), len(b.get(k, []))) for k in {*a, *b} if a.get(k) != b.get(k)), key=repr)


@pytest.mark.parametrize("fan,leaf_rows", [(8, 5), (1024, 50_000), (64, 1)])
def test_all_kinds_of_difference(spark, fan, leaf_rows):
    rnd = random.Random(1)
    rows = [(rnd.choice([rnd.randrange(-500, 500), rnd.randrange(10**12), None]), rnd.choice(["a", "b", None]), rnd.random()) for _ in range(600)]
    other = [r if rnd.random() > 0.05 else (r[0], r[1], -1.0) for r in rows if rnd.random() > 0.03]
    other += [(rnd.randrange(-9000, 9000), "new", 0.5) for _ in range(15)] + other[:9]
    rnd.shuffle(other)
    frames = [spark.createDataFrame(x, "k long, t string, v double").repartition(3) for x in (rows, other)]
    assert found(*frames, fan=fan, leaf_rows=leaf_rows) == by_force(rows, other)
    assert found(frames[0], frames[0].repartition(7), fan=fan, leaf_rows=leaf_rows) == []


@pytest.mark.parametrize("kind,value", [("date", lambda i: date(2024, 1, 1) + timedelta(days=i)),
                                        ("timestamp_ntz", lambda i: datetime(2024, 1, 1) + timedelta(seconds=7 * i, microseconds=i)), ("int", lambda i: i - 50)])
def test_kinds_of_keys(spark, kind, value):
    rows = [(value(i), i) for i in range(200)]
    other = [r for r in rows if r[1] != 77] + [(value(300), 1)]
    frames = [spark.createDataFrame(x, f"k {kind}, v int") for x in (rows, other)]
    assert found(*frames, fan=16, leaf_rows=3) == sorted([(value(77), "missing", 1, 0), (value(300), "extra", 0, 1)], key=repr)


def test_empty_sides_and_wrong_keys(spark):
    some, none = (spark.createDataFrame(x, "k long, v int") for x in ([(1, 1), (None, 2)], []))
    assert found(some, none) == sorted([(1, "missing", 1, 0), (None, "missing", 1, 0)], key=repr)
    assert found(none, none) == []
    with pytest.raises(ValueError):
        V.reconcile_ranges(some.selectExpr("cast(k as string) k", "v"), some, "k")


def test_one_changed_row_reads_little(spark):
    n, path = 200_000, scratch_path(spark, "reconcile")
    spark.range(n).selectExpr("id AS k", "id * 2 AS v").repartitionByRange(300, "k").write.parquet(path)
    source = spark.read.parquet(path)
    copy = source.withColumn("v", F.when(F.col("k") == 123_456, -1).otherwise(F.col("v")))
    ranges = V.differing_ranges(source, copy, "k", leaf_rows=1000)
    again = source.where(V._Key(source, "k").within(ranges))
    assert again.count() <= n / 500 and len(ranges) == 1
    # what the scan itself reads: whole files are left out by their statistics
    again.select("k", "v").write.format("noop").mode("overwrite").save()
    df = again.select("k", "v")
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert "PushedFilters: [" in scan.toString() or "DataFilters" in scan.toString()
    assert 0 < scan.metrics().apply("numOutputRows").value() < n / 100
    assert found(source, copy, leaf_rows=1000) == [(123_456, "changed", 1, 1)]
