"""A clean-up over two tables that is killed after any step ends like one that ran through."""

from datetime import datetime, timedelta

import pytest
from conftest import data
from pyspark.sql import functions as F

from huntlake.operators import cleanup as K
from huntlake.session import scratch_path
from huntlake.sources.files import Files
from huntlake.sources.sinks import write_events

AS_OF = datetime(2024, 3, 1, 12)


class Killed(Exception):
    pass


@pytest.fixture
def stored(spark):
    base = scratch_path(spark, "cleanup-test")
    rows = [(i, AS_OF - timedelta(hours=7 * i)) for i in range(60)] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz")
    tables = []
    for name, days in (("a", 10), ("b", 3)):
        write_events(df, f"{base}/{name}", files=3)
        tables.append(K.StoredTable(name, f"{base}/{name}", days))
    return base, tables, rows


def left(spark, table):
    return sorted(r.id for r in spark.read.parquet(table.path).collect())


def check_end(spark, base, tables, rows):
    for t in tables:
        limit = AS_OF - timedelta(days=t.days)
        assert left(spark, t) == sorted(i for i, ts in rows if ts is None or ts >= limit)
    assert Files(spark).names(f"{base}/journal") == []


def test_report_and_log(spark, stored):
    base, tables, rows = stored
    report = K.cleanup_job(spark, tables, AS_OF, f"{base}/journal", f"{base}/log")
    gone = {t.name: sum(ts is not None and ts < AS_OF - timedelta(days=t.days) for _, ts in rows) for t in tables}
    assert {r.table_name: r.rows_deleted for r in report.collect()} == gone and all(gone.values())
    check_end(spark, base, tables, rows)
    again = K.cleanup_job(spark, tables, AS_OF, f"{base}/journal", f"{base}/log")
    assert {r.table_name: r.rows_deleted for r in again.collect()} == {"a": 0, "b": 0}
    assert {r.table_name: r.rows_deleted for r in K.cleanup_history(spark, f"{base}/log").collect()} == gone


def test_killed_anywhere(spark, stored, monkeypatch):
    base, tables, rows = stored
    move, delete = Files.move, Files.delete
    total = {t.name: sum(ts is not None and ts < AS_OF - timedelta(days=t.days) for _, ts in rows) for t in tables}
    step = [0]

    def dying(real):
        def call(self, *args):
            step[0] -= 1
            if step[0] == 0:
                raise Killed
            return real(self, *args)
        return call

    monkeypatch.setattr(Files, "move", dying(move))
    monkeypatch.setattr(Files, "delete", dying(delete))
    # each try dies a little later than the one before; what earlier ones did is taken over
    for n in (1, 2, 3, 5, 8, 13, 21):
        step[0] = n
        try:
            K.cleanup_job(spark, tables, AS_OF, f"{base}/journal", f"{base}/log")
        except Killed:
            pass
    step[0] = 0
    K.cleanup_job(spark, tables, AS_OF, f"{base}/journal", f"{base}/log")
    check_end(spark, base, tables, rows)
    log = K.cleanup_history(spark, f"{base}/log").groupBy("table_name").agg(F.sum("rows_deleted")).collect()
    assert dict(map(tuple, log)) == total


def test_undecided_runs_are_undone(spark, stored, monkeypatch):
    base, tables, rows = stored
    before = [left(spark, t) for t in tables]
    monkeypatch.setattr(Files, "write_note", lambda *a: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        K.cleanup_job(spark, tables, AS_OF, f"{base}/journal", f"{base}/log")
    assert [left(spark, t) for t in tables] == before and Files(spark).names(f"{base}/journal")
    assert K.recover(spark, f"{base}/journal", f"{base}/log") == []
    assert Files(spark).names(f"{base}/journal") == [] and [left(spark, t) for t in tables] == before


def test_rows_appended_meanwhile_stay(spark, stored, monkeypatch):
    base, tables, rows = stored
    t = tables[0]
    edge = (AS_OF - timedelta(days=t.days)) + timedelta(hours=1)
    real = Files.write_note

    def late(self, path, note):
        write_events(spark.createDataFrame([(777, edge)], "id long, timestamp timestamp_ntz"), t.path, files=1)
        real(self, path, note)

    monkeypatch.setattr(Files, "write_note", late)
    K.cleanup_job(spark, [t], AS_OF, f"{base}/journal", f"{base}/log")
    assert 777 in left(spark, t)


def test_nothing_to_clean(spark, stored):
    base, tables, _ = stored
    far = [K.StoredTable(t.name, t.path, 1000) for t in tables]
    assert data(K.cleanup_job(spark, far, AS_OF, f"{base}/journal", f"{base}/log").select("table_name", "rows_deleted")) == [(0, "a"), (0, "b")]
