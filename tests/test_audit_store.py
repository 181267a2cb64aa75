"""Audit rows are stored once, and nothing is revealed without a stored row."""

from datetime import datetime, timedelta

import pytest
from conftest import data
from pyspark.sql import functions as F

from huntlake.functions import masking as M
from huntlake.functions import parse as X
from huntlake.operators import privacy as P
from huntlake.session import scratch_path
from huntlake.sources.audit_store import AuditStore, deanonymization_store, deanonymize_logged, operations_store

KEY, SALT, T0 = "0123456789abcdef0123456789abcdef", "salt", datetime(2024, 1, 1, 23, 30)


@pytest.fixture
def case(spark):
    values = spark.createDataFrame([("ann", "user"), ("bob", "user")], "original string, field_type string")
    none = spark.createDataFrame([], "anonymized_value string, field_type string")
    mappings = P.new_mappings(values, none, SALT, KEY, "2024-01-01")
    masked = dict(map(tuple, values.select("original", M.mask_user(F.col("original"), SALT)).collect()))
    rows = [(1, "admin", "user", masked["ann"], "why", T0), (2, "hunter", "user", masked["bob"], "why", T0 + timedelta(hours=1)),
            (3, "nobody", "user", masked["bob"], "why", T0 + timedelta(hours=2)), (4, "admin", "user", "unknown", "why", T0)]
    requests = spark.createDataFrame(rows, "request_id long, user string, field_type string, anonymized_value string, reason string, req_ts timestamp_ntz")
    levels = spark.createDataFrame([("admin", None, 3), ("hunter", "user", 2)], "user string, field_type string, level int")
    approvals = spark.createDataFrame([("hunter", "user", masked["bob"], T0 + timedelta(minutes=30))],
                                      "user string, field_type string, anonymized_value string, appr_ts timestamp_ntz")
    return requests, mappings, levels, approvals


def shown(df):
    return {r.request_id: (r.reason_code, r.revealed, r.original_value) for r in df.collect()}


WANT = {1: ("level3", True, "ann"), 2: ("approved", True, "bob"), 3: ("level1", False, None), 4: ("level3", False, None)}


def test_every_request_once(spark, case):
    store = deanonymization_store(spark, scratch_path(spark, "deanon-test"))
    assert shown(deanonymize_logged(*case, KEY, store)) == WANT
    first = data(store.read())
    assert shown(deanonymize_logged(*case, KEY, store)) == WANT
    assert data(store.read()) == first and len(first) == 4
    assert "ann" not in str(first) and "bob" not in str(first)
    assert sorted(str(r.audit_day) for r in store.read().collect()) == ["2024-01-01", "2024-01-01", "2024-01-02", "2024-01-02"]


def test_half_a_batch_is_completed(spark, case):
    requests, *rest = case
    store = deanonymization_store(spark, scratch_path(spark, "deanon-test"))
    deanonymize_logged(requests.where("request_id IN (1, 3)"), *rest, KEY, store)
    assert shown(deanonymize_logged(requests, *rest, KEY, store)) == WANT
    assert sorted(r.request_id for r in store.read().collect()) == [1, 2, 3, 4]


def test_nothing_without_a_stored_row(spark, case, monkeypatch):
    store = deanonymization_store(spark, scratch_path(spark, "deanon-test"))
    monkeypatch.setattr(AuditStore, "append", lambda self, rows: rows)  # a store that loses rows
    assert shown(deanonymize_logged(*case, KEY, store)) == {}


def test_a_request_stored_as_denied_stays_denied(spark, case):
    requests, mappings, levels, approvals = case
    store = deanonymization_store(spark, scratch_path(spark, "deanon-test"))
    deanonymize_logged(requests, mappings, levels, approvals.limit(0), KEY, store)
    again = shown(deanonymize_logged(requests, mappings, levels, approvals, KEY, store))
    assert again[2] == ("not_approved", False, None) and again[1] == WANT[1]


def test_operations(spark):
    store = operations_store(spark, scratch_path(spark, "audit-test"))
    line = "user_id=u1 | vm_id=v | operation=ls | start=2024-01-01T10:00:00 | end=2024-01-01T10:00:05 | status=success | extra={'password': 'hunter2', 'ok': True}"
    parsed = X.parse_audit(spark.createDataFrame([(line,), (line,), (line.replace("u1", "u2"),)], "line string"))
    assert store.append(parsed).count() == 2 and store.append(parsed).count() == 0
    rows = store.read().collect()
    assert sorted(r.user_id for r in rows) == ["u1", "u2"] and all("hunter2" not in r.extra and "True" in r.extra for r in rows)


@pytest.mark.parametrize("raw,gone", [
    ("{'password': 'hunter2', 'ok': True}", "hunter2"), ("password=hunter2 ok=1", "hunter2"), ('{"secret": "a\\"hunter2", broken', "hunter2"),
    ("x; key: hunter2, ok", "hunter2"), ("password='hunter2", "hunter2"),
])
def test_raw_text_is_redacted(spark, raw, gone):
    df = spark.createDataFrame([(raw,)], "t string").select(X.redact_map(X.json_or_raw(F.col("t"))).alias("m"))
    assert gone not in df.first().m["_raw"]


def test_other_text_stays(spark):
    raw = "monkey: banana, keyboard=us {"
    assert spark.createDataFrame([(raw,)], "t string").select(X.redact_map(X.json_or_raw(F.col("t"))).alias("m")).first().m == {"_raw": raw}
