"""Sliced hot keys must give what plain windows give."""

from datetime import datetime, timedelta

import pytest
from conftest import data
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.operators import detect as D
from huntlake.plans.ordered import MAX_HOT_KEYS, Ordered, by_key, hot_key_table
from huntlake.plans.quantiles import _intervals, _region, bracket_aggs, exact_quantiles

T0 = datetime(2024, 1, 1)
SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("k", T.StringType()), T.StructField("event_type", T.StringType()),
])


def hashed(i, salt):
    return (i * 2654435761 + salt * 40503) % 2**32


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows on one key, many equal instants, a NULL key, two quiet keys."""
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{hashed(i, 1) % 40}")
        second = hashed(i, 2) % 20000 // 7 * 7
        rows.append((i, T0 + timedelta(seconds=second), key, "ab"[hashed(i, 3) % 2]))
    rows += [(5000, T0, "one", "a"), (5001, T0, "two", "b"), (5002, T0, "two", "a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df.cache()
    return df


def test_hot_keys_are_found(spark, skewed):
    assert hot_key_table(skewed, ["k"], 10**6) is None
    assert [r.k for r in hot_key_table(skewed, ["k"], 300).collect()] == ["hot"]
    assert MAX_HOT_KEYS > 0


@pytest.mark.parametrize("hot_rows", [0, 20, 300])
def test_primitives(skewed, hot_rows):
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    grow = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.withColumns({
        "prev": F.lag("ts").over(w), "prev_type": F.lag("event_type").over(w),
        "total": F.sum("event_id").over(grow),
        "seen": F.last(F.when(F.col("event_type") == "a", F.col("event_id")), ignorenulls=True).over(grow),
    })

    def step(o):
        o = o.previous(prev=F.col("ts"), prev_type=F.col("event_type")).running_sum("total", F.col("event_id"))
        return o.last_seen("seen", F.when(F.col("event_type") == "a", F.col("event_id"))).df

    got = by_key(skewed, ["k"], ["ts", "event_id"], step, hot_rows)
    assert data(got) == data(want.select(*got.columns))


def test_carry_crosses_many_slices(skewed):
    hot = skewed.where("k = 'hot'")
    o = Ordered.slices(hot, ["k"], ["ts", "event_id"], parts=16)
    assert o.df.select("_slice").distinct().count() > 8
    total = o.running_sum("n", F.lit(1)).df
    assert sorted(r.n for r in total.collect()) == list(range(1, hot.count() + 1))


@pytest.mark.parametrize("hot_rows", [0, 20, 300])
def test_operators_on_hot_keys(skewed, hot_rows):
    names = {"ts": "ts", "event_id": "event_id"}
    cases = [
        lambda n: D.behavior_gaps(skewed, "k", hot_rows=n),
        lambda n: D.user_sessions(skewed, "k", gap_seconds=120, hot_rows=n),
        lambda n: D.burst_detect(skewed, "k", maxretry=4, findtime=60, hot_rows=n, **names),
        lambda n: D.correlate_interval(skewed, F.col("event_type") == "a", F.col("event_type") == "b", "k", within=30, hot_rows=n),
    ]
    for case in cases:
        want = data(case(10**9))
        assert want and data(case(hot_rows)) == want


def brute_bans(rows, maxretry, findtime, bantime):
    out, state = [], {}
    for eid, ts, key, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[1], r[0])):
        recent, until = state.get(key, ([], datetime.min))
        if ts < until:
            continue
        recent = [r for r in recent if (ts - r).total_seconds() <= findtime] + [ts]
        if len(recent) >= maxretry:
            until, recent = ts + timedelta(seconds=bantime), []
            out.append((until, ts, eid, key))
        state[key] = (recent, until)
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows", [0, 300, 10**9])
@pytest.mark.parametrize("rule", [(1, 60, 100), (3, 200, 400), (5, 600, 3600)])
def test_bans_equal_brute_force(skewed, hot_rows, rule):
    if hot_rows == 0 and rule[0] != 3:
        pytest.skip("one rule is enough where every key is hot")
    got = D.ban_intervals(skewed, "k", maxretry=rule[0], findtime=rule[1], bantime=rule[2], hot_rows=hot_rows)
    want = brute_bans([tuple(r) for r in skewed.collect()], *rule)
    assert want and data(got) == want


def test_correlation_equals_pairs(skewed):
    rows = [tuple(r) for r in skewed.collect() if r.k is not None]
    want = []
    for eid, ts, key, kind in rows:
        after = sorted((b[1], b[0]) for b in rows
                       if kind == "a" and b[3] == "b" and b[2] == key and 0 < (b[1] - ts).total_seconds() <= 30)
        if after:
            want.append((eid, ts, after[0][1], after[0][0], key, len(after)))
    got = D.correlate_interval(skewed, F.col("event_type") == "a", F.col("event_type") == "b", "k", within=30)
    assert data(got) == sorted(want, key=repr)


def test_cross_source_equals_pairs(skewed):
    df = skewed.withColumn("source_system", F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")))
    rows = [r for r in df.collect() if r.k is not None]
    want = []
    for a in rows:
        n = sum(1 for b in rows if a.event_type == "a" and b.event_type == "b" and b.k == a.k
                and b.source_system != a.source_system and 0 < (b.ts - a.ts).total_seconds() <= 30)
        if n:
            want.append((a.event_id, a.ts, a.k, n))
    for hot_rows in (10**9, 100):
        got = D.correlate_sources(df, F.col("event_type") == "a", F.col("event_type") == "b", "k", within=30, hot_rows=hot_rows)
        assert data(got) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def untidy(skewed):
    """Events delivered up to three times, NULL times and NULL ids."""
    again = skewed.where("event_id % 5 = 0").union(skewed.where("event_id % 10 = 0"))
    odd = skewed.withColumns({"ts": F.when(F.col("event_id") % 7 != 0, F.col("ts")), "event_id": F.when(F.col("event_id") % 11 != 0, F.col("event_id"))})
    df = odd.union(again).withColumn("source_system", F.concat(F.lit("s"), (F.hash("ts") % 3).cast("string")))
    df.cache()
    return df


@pytest.mark.parametrize("hot_rows", [0, 20])
def test_untidy_rows_give_one_answer(untidy, hot_rows):
    a, b = F.col("event_type") == "a", F.col("event_type") == "b"
    cases = [
        lambda n: D.burst_detect(untidy, "k", maxretry=4, findtime=60, hot_rows=n),
        lambda n: D.ban_intervals(untidy, "k", maxretry=3, findtime=200, bantime=400, hot_rows=n),
        lambda n: D.correlate_interval(untidy, a, b, "k", within=30, hot_rows=n),
        lambda n: D.correlate_sources(untidy, a, b, "k", within=30, hot_rows=n),
    ]
    for case in cases:
        want = data(case(10**9))
        assert want and data(case(hot_rows)) == want


def test_untidy_counts(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(1, at(0), "x", "a")] * 3 + [(2, at(5), "x", "b")] * 2 + [(3, None, "x", "a")] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    for hot_rows in (0, 10**9):
        bursts = D.burst_detect(df.where("event_type = 'a'"), "k", maxretry=2, hot_rows=hot_rows).collect()
        assert [(r.event_id, r.n_failures) for r in bursts] == [(1, 3)] * 3
        assert D.ban_intervals(df.where("event_id = 3"), "k", maxretry=2, hot_rows=hot_rows).isEmpty()
        found = D.correlate_interval(df, F.col("event_type") == "a", F.col("event_type") == "b", "k", hot_rows=hot_rows).collect()
        assert [(r.a_id, r.b_id, r.n_followers) for r in found] == [(1, 2, 2)] * 3


def test_quantiles(spark):
    df = spark.createDataFrame([(float(i % 17), i if i % 5 else None) for i in range(101)], "a double, b int")
    got = {(r.column_name, r.p): r.q for r in exact_quantiles(df, ["a", "b"], (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    pdf = df.toPandas()
    for c in ("a", "b"):
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert abs(got[(c, p)] - pdf[c].quantile(p)) < 1e-9


def test_empty_input_and_no_findings(skewed):
    none = skewed.where("false")
    a, b = F.col("event_type") == "a", F.col("event_type") == "b"
    for df in (none,):
        assert D.behavior_gaps(df, "k").isEmpty()
        assert D.user_sessions(df, "k").isEmpty()
        assert D.burst_detect(df, "k").isEmpty()
        assert D.ban_intervals(df, "k").isEmpty()
        assert D.correlate_interval(df, a, b, "k").isEmpty()
    hot = skewed.where("k = 'hot'")
    assert D.ban_intervals(hot, "k", maxretry=1000, hot_rows=10).isEmpty()
    assert D.burst_detect(hot, "k", maxretry=1000, hot_rows=10).isEmpty()


@pytest.mark.parametrize("rows,accuracy,hot_rows", [(1, 10_000, 10**6), (3, 10_000, 10**6), (20_000, 100, 10**6), (20_000, 100, 5), (20_000, 1000, 10**6)])
def test_quantiles_between_brackets(spark, rows, accuracy, hot_rows):
    """Ranks are found whether brackets hold few rows or many, and beside values that hold a large part of all rows."""
    df = spark.range(rows).selectExpr(
        "cast(hash(id) % 1000003 as double) AS spread", "id % 3 AS few", "if(id % 10 < 7, 5, id) AS tied", "if(id % 4 = 0, NULL, id / 7) AS holes",
        "cast(null as double) AS none")
    columns, probs = ["spread", "few", "tied", "holes", "none"], (0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0)
    got = {(r.column_name, r.p): r.q for r in exact_quantiles(df, columns, probs, accuracy=accuracy, hot_rows=hot_rows).collect()}
    pdf = df.toPandas()
    want = {(c, p): pdf[c].quantile(p) for c in columns if pdf[c].notna().any() for p in probs}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_quantiles_shuffle_little(spark):
    """What goes between tasks is a small part of the rows, though nearly all values differ."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    df = spark.range(200_000).selectExpr("cast(hash(id) as double) AS v")
    seen = df.agg(*bracket_aggs(["v"], (0.25, 0.5, 0.75))).first()
    inside = [(lo, hi) for lo, hi in _intervals(seen, 0)]
    count = Observation()
    df.observe(count, F.sum(F.when((_region(F.col("v"), inside) % 2) == 1, 1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert count.get["n"] < 200_000 / 100
