"""Time filters reach folders and files."""

from datetime import datetime, timedelta

import pytest
from conftest import data

from huntlake.operators import filters as P
from huntlake.operators import playbooks as B
from huntlake.operators import retention as R
from huntlake.session import scratch_path
from huntlake.sources.event_store import EventStore
from huntlake.sources.files import Files
from huntlake.sources.sinks import write_events

T0 = datetime(2024, 1, 1)


def rows(spark, n, step, start=0):
    made = [(i, T0 + timedelta(minutes=step * i)) for i in range(start, n)] + [(10**6 + start, None)]
    return spark.createDataFrame(made, "id long, timestamp timestamp_ntz")


@pytest.fixture
def store(spark):
    df = rows(spark, 600, 20)  # eight days and a bit
    out = EventStore(spark, scratch_path(spark, "event-store-test"), df.schema)
    out.append(df, files=40)
    return out


def pruned(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "PartitionFilters: [isnotnull(event_date" in plan or "PartitionFilters: [(event_date" in plan


def test_ranges(spark, store):
    for start, hours in ((T0, 1), (T0 + timedelta(hours=30, minutes=7), 5), (T0 + timedelta(days=2), 48), (T0 - timedelta(days=9), 24), (T0 + timedelta(days=40), 1)):
        end = start + timedelta(hours=hours)
        want = sorted(i for i in range(600) if start <= T0 + timedelta(minutes=20 * i) < end)
        got = store.between(start, end)
        assert sorted(r.id for r in got.collect()) == want
        assert not want or pruned(got)


def test_an_hour_reads_the_files_of_that_hour(spark, store):
    total = sum(len(store._files(d)) for d in store._days())
    chosen = store.files_between(T0 + timedelta(hours=30), T0 + timedelta(hours=31))
    assert total >= 20 and 1 <= len(chosen) <= 2
    assert sum(r.rows for r in store.times().collect()) == 601


def test_unknown_and_vanished_files(spark, store):
    write_events(rows(spark, 700, 20, 600), store.path, files=2)
    assert store.between(T0 + timedelta(minutes=20 * 650), datetime(2025, 1, 1)).count() == 50  # not in the table of times yet
    assert store.refresh() > 0 and store.refresh() == 0
    assert store.between(T0, datetime(2025, 1, 1)).count() == 700
    Files(spark).delete(f"{store.path}/event_date=2024-01-02")
    assert store.between(T0, T0 + timedelta(days=3)).count() == 72 * 2
    assert [r.id for r in store.recent(T0 + timedelta(minutes=20 * 699), 1).collect()] == [699, 698, 697, 696]


def test_nothing_stored(spark):
    empty = EventStore(spark, scratch_path(spark, "event-store-none"), rows(spark, 1, 1).schema)
    assert empty.between(T0, T0 + timedelta(days=1)).collect() == [] and empty.refresh() == 0


def test_plans_prune_folders(spark, store):
    stored, as_of = store.read(), T0 + timedelta(days=5)
    near = P.recent(stored, "timestamp", as_of, 24, "event_date")
    assert pruned(near) and data(near) == data(P.recent(stored, "timestamp", as_of, 24))
    params = B.Params("2024-01-02", "2024-01-03", {}, "event_date")
    assert pruned(B.scope(stored, params, "timestamp"))
    assert data(B.scope(stored, params, "timestamp")) == data(B.scope(stored, B.Params("2024-01-02", "2024-01-03"), "timestamp"))
    report = R.retention_report({"events": stored}, {"events": 3}, as_of, partition_dates={"events": "event_date"})
    assert pruned(report) and data(report) == data(R.retention_report({"events": stored}, {"events": 3}, as_of))
