"""Streams that arrive in several files end where the batch ends; late rows are dropped."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import data
from pyspark.sql import functions as F

from huntlake.operators import detect as D
from huntlake.session import scratch_path
from huntlake.sources.adapter import security_events
from huntlake.streaming import bans as B
from huntlake.streaming import live as L
from huntlake.streaming import sequences as Q
from huntlake.streaming.enrich import enriched, live_enrich
from huntlake.streaming.inorder import ROW


@pytest.fixture(scope="module")
def landing(spark, sf):
    """The events table as four files in time order, one per micro-batch, and a far later row that
    closes every window."""
    path = scratch_path(spark, "landing")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(4):
        lo, hi = (datetime(2024, 1, 1) + timedelta(days=8 * j) for j in (i, i + 1))
        ev.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).coalesce(1).write.mode("append").parquet(path)
    last = ev.limit(1).select(F.lit(10**9).cast("long").alias("event_id"), F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz").alias("ts"),
                              F.lit(10**9).cast("long").alias("user_id"), F.lit("error").alias("event_type"), "value", "props")
    last.coalesce(1).write.mode("append").parquet(path)
    return path


def live(spark, landing, files=1):
    schema = spark.read.parquet(landing).schema
    return security_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(landing))


def batch(spark, landing):
    return security_events(spark.read.parquet(landing)).where("event_id < 1000000000")


def plain(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def test_sessions(spark, landing):
    got = plain(L.run_available(L.live_sessions(live(spark, landing), gap="6 hours"), "t-sessions"), "session_start", "session_end")
    want = D.user_sessions(batch(spark, landing), gap_seconds=6 * 3600).select(
        "user_id", "session_start", (F.col("session_end") + F.expr("INTERVAL 6 HOURS")).alias("session_end"), "n_events")
    assert data(got) == data(want)


def test_tumbling(spark, landing):
    got = plain(L.run_available(L.tumbling_counts(live(spark, landing), "ts", "1 hour"), "t-tumbling"), "window_start", "window_end")
    want = batch(spark, landing).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 1 HOUR"))
    assert data(got) == data(want)


def test_sequence(spark, landing):
    t = F.col("event_type")
    got = plain(L.run_available(Q.live_sequence(live(spark, landing), t == "error", t == "purchase"), "t-sequence"), "a_ts", "b_ts")
    want = D.correlate_interval(batch(spark, landing), t == "error", t == "purchase").select("user_id", "a_id", "a_ts", "b_id", "b_ts")
    assert data(got) == data(want)


@pytest.fixture(scope="module")
def delayed(spark):
    """Twelve hours in six files of two hours each; a third of the last 50 minutes of a file comes with the next one, files are shuffled,
    some rows come twice, and a last row closes everything. (path, rows that are not too late)"""
    rnd, t0 = random.Random(5), datetime(2024, 1, 1)
    rows = [(f"s{rnd.randrange(5)}", t0 + timedelta(seconds=rnd.randrange(12 * 3600)), i, rnd.randrange(3)) for i in range(2000)]
    rows += rows[:40] + [("s1", t0 + timedelta(hours=3), None, 1), (None, t0 + timedelta(hours=3), 5, 1)]
    files = [[] for _ in range(6)]
    for row in rows:
        at = (row[1] - t0).total_seconds()
        late = at % 7200 > 7200 - 3000 and rnd.random() < 0.3
        files[min(5, int(at // 7200) + late)].append(row)
    too_late = ("s0", t0 + timedelta(minutes=1), 10**8, 1)
    files[4].append(too_late)
    files.append([("end", t0 + timedelta(days=3), 10**9, 0)])
    path = scratch_path(spark, "delayed")
    for f in files:
        rnd.shuffle(f)
        spark.createDataFrame(f, DELAYED).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(rows, DELAYED)


DELAYED = "source_ip string, ts timestamp_ntz, event_id long, sort int"


@pytest.mark.parametrize("rule", [{"maxretry": 4, "findtime": 300, "bantime": 900}, {"maxretry": 1, "findtime": 60, "bantime": 1800}])
def test_bans_with_late_rows(spark, delayed, rule):
    path, rows = delayed
    stream = spark.readStream.schema(DELAYED).option("maxFilesPerTrigger", 1).parquet(path)
    got = plain(L.run_available(B.live_bans(stream, **rule), "t-late-bans"), "ban_start", "ban_end").where("source_ip <> 'end'")
    want = D.ban_intervals(rows, **rule)
    assert data(got) == data(want) and want.count() > 20


def test_sequence_with_late_rows(spark, delayed):
    path, rows = delayed
    a, b = F.col("sort") == 0, F.col("sort") == 1
    stream = spark.readStream.schema(DELAYED).option("maxFilesPerTrigger", 1).parquet(path)
    got = plain(L.run_available(Q.live_sequence(stream, a, b, "source_ip", within_seconds=40), "t-late-sequence"), "a_ts", "b_ts")
    want = D.correlate_interval(rows.where("source_ip IS NOT NULL"), a, b, "source_ip", within=40).select("source_ip", "a_id", "a_ts", "b_id", "b_ts")
    assert data(got) == data(want) and want.count() > 80


def test_ban_state_is_small_and_goes():
    rule = B.Bans("s", "ts", "id", maxretry=3, findtime=10, bantime=60)
    rows = np.zeros(1000, ROW)
    rows["t"] = np.arange(1000) * 20_000_000  # never three within ten seconds
    out, held, until = rule.take(("x",), b"", rows, 10**12)
    assert out is None and len(held) <= 8 * 3 and until == 999 * 20_000_000 + 10_000_000


class FewCalls:
    """State of one shard that counts its calls."""

    def __init__(self):
        self.maps, self.value, self.timers, self.calls = {}, {}, set(), 0

    def getMapState(self, *_):
        return self

    def getValueState(self, name, _):
        return FewCallsValue(self, name)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def keys(self):
        return list(self.maps)

    def updateValue(self, k, v):
        self.calls += 1
        self.maps[k] = v

    def getValue(self, k):
        self.calls += 1
        return self.maps[k]

    def removeKey(self, k):
        self.calls += 1
        del self.maps[k]

    def getCurrentWatermarkInMs(self):
        return self.watermark


class FewCallsValue:
    def __init__(self, owner, name):
        self.owner, self.name = owner, name

    def exists(self):
        return self.name in self.owner.value

    def get(self):
        return self.owner.value[self.name]

    def update(self, v):
        self.owner.value[self.name] = v

    def clear(self):
        self.owner.value.pop(self.name, None)


@pytest.mark.parametrize("chunk", [500_000, 100])
def test_state_is_called_per_part_not_per_minute(monkeypatch, chunk):
    monkeypatch.setattr("huntlake.streaming.inorder.CHUNK_ROWS", chunk)
    rule, state = B.Bans("s", "ts", "id", maxretry=3, findtime=600, bantime=900), FewCalls()
    rule.init(state)
    t = np.sort(np.random.default_rng(3).integers(0, 10 * 86_400, 5000)) * 1_000_000
    rows = pd.DataFrame({"key": "x", "t": pd.to_datetime(t, unit="us"), "known": True, "id": np.arange(5000), "kind": 0}).sample(frac=1, random_state=1)
    list(rule.handleInputRows((1,), iter([rows[:2000], rows[2000:]]), None))
    found = []
    for day in (4, 4.0001, 7.3, 11):  # the watermark of four micro-batches, none with rows of its own
        state.watermark = int(day * 86_400_000)
        for _ in range(len([x for x in state.timers if x <= state.watermark])):
            found += list(rule.handleExpiredTimer((1,), state, None))
        state.timers = {x for x in state.timers if x > state.watermark}
    assert pd.concat(found)["id"].tolist() == B.bans_in(t, 3, 600_000_000, 900_000_000)[0] and len(pd.concat(found)) > 50
    assert not state.maps and not state.timers and "held" not in state.value
    assert chunk < 500_000 or state.calls < 120


def test_bans(spark, landing):
    rule = {"source": "source_system", "maxretry": 2, "findtime": 3600, "bantime": 7200}
    got = plain(L.run_available(B.live_bans(live(spark, landing).where("event_type = 'error'"), **rule), "t-bans"), "ban_start", "ban_end")
    want = D.ban_intervals(batch(spark, landing).where("event_type = 'error'"), **rule)
    assert data(got) == data(want) and want.count() > 3


def test_late_rows_are_dropped(spark):
    path = scratch_path(spark, "late")
    t = datetime(2024, 1, 1, 12)
    for when in (t, t + timedelta(hours=5), t + timedelta(hours=6), t + timedelta(minutes=1), t + timedelta(hours=9)):
        spark.createDataFrame([(when,)], "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "t-late")
    query = L.start_available(L.tumbling_counts(stream), out)
    query.awaitTermination()
    assert L.late_rows(query) == 1
    got = spark.read.parquet(out)
    assert sorted((r.window_start.hour, r.n) for r in got.collect()) == [(12, 1), (17, 1), (18, 1)]


def test_enrichment_follows_its_table(spark):
    """A row that is added to the table, one that is changed and one that goes, between two micro-batches."""
    base = scratch_path(spark, "enrich-test")
    events = lambda ids: spark.createDataFrame([(i, f"s{i % 3}") for i in ids], "event_id long, source_system string").coalesce(1).write.mode("append").parquet(base + "/in")
    table = lambda rows: spark.createDataFrame(rows, "source_system string, owner string").write.mode("overwrite").parquet(base + "/table")

    def go_on():
        stream = spark.readStream.schema("event_id long, source_system string").parquet(base + "/in")
        live_enrich(stream, lambda s: s.read.parquet(base + "/table"), base + "/out").awaitTermination()

    table([("s0", "ann"), ("s2", "cy")])
    events(range(3))
    go_on()
    table([("s0", "dee"), ("s1", "bob")])
    events(range(3, 6))
    go_on()
    got = sorted((r.event_id, r.owner) for r in enriched(spark, base + "/out").collect())
    assert got == [(0, "ann"), (1, None), (2, "cy"), (3, "dee"), (4, "bob"), (5, None)]


def test_a_repeated_batch_replaces_itself(spark):
    base = scratch_path(spark, "enrich-again")
    spark.range(5).selectExpr("id AS event_id", "'s' AS source_system").write.parquet(base + "/in")
    calls = []

    def table(session):
        calls.append(1)
        if len(calls) == 2:  # fails when the batch is written for the first time, after the table was read
            raise RuntimeError("gone for a moment")
        return session.createDataFrame([("s", "ann")], "source_system string, owner string")

    stream = lambda: spark.readStream.schema("event_id long, source_system string").parquet(base + "/in")
    calls.append(1)
    with pytest.raises(Exception):
        live_enrich(stream(), table, base + "/out").awaitTermination()
    live_enrich(stream(), table, base + "/out").awaitTermination()
    assert sorted(r.event_id for r in enriched(spark, base + "/out").collect()) == list(range(5))
