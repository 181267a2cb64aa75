"""Edge cases of the table operators."""

from datetime import date, datetime, timedelta

import pytest
from conftest import data
from pyspark.sql import functions as F

from huntlake.operators import aggregate as A
from huntlake.operators import compare as C
from huntlake.operators import detect as D
from huntlake.operators import filters as P
from huntlake.operators import playbooks as B
from huntlake.operators import privacy as V
from huntlake.operators import quality as Q
from huntlake.operators import retention as T
from huntlake.session import scratch_path
from huntlake.sources import readers as R
from huntlake.sources import sinks as W
from huntlake.operators.records import SchemaError
from huntlake.sources import snapshots as S
from huntlake.suite.base import events

KEY = "0123456789abcdef0123456789abcdef"


def errors(spark, record, schema):
    return Q.validate(spark.createDataFrame([(record,)], "j string"), "j", schema).first().errors


ALERT = {
    "type": "object", "title": "an alert", "required": ["rule", "source"], "additionalProperties": False,
    "properties": {
        "rule": {"type": "string", "minLength": 2, "maxLength": 8, "pattern": "^[a-z]+$"},
        "score": {"type": "number", "exclusiveMinimum": 0, "maximum": 10, "multipleOf": 0.5},
        "seen": {"type": "integer"},
        "state": {"enum": ["open", "closed", None, 7]},
        "source": {"type": "object", "required": ["ip"], "properties": {"ip": {"type": ["string", "null"]}, "o'port": {"type": "integer"}}},
        "tags": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 3, "uniqueItems": True},
        "path": {"type": "array", "items": {"type": "array", "items": {"properties": {"hop": {"type": "integer", "minimum": 1}}}}},
    },
}
OPEN = {"properties": {"original": {"const": {"a": [1, 2.0]}}}, "additionalProperties": {"type": "boolean"}, "minProperties": 1,
        "maxProperties": 2, "propertyNames": {"maxLength": 8}}
CHOICE = {"properties": {"v": {"oneOf": [{"type": "integer"}, {"type": "number", "minimum": 5}]}, "w": {"anyOf": [{"type": "null"}, {"minimum": 3}]},
                         "x": {"not": {"type": "string"}}, "y": {"allOf": [{"minimum": 1}, {"maximum": 2}]}, "z": {"contains": {"const": 1}}, "no": False}}
SOURCE = '"source": {"ip": null}'


@pytest.mark.parametrize("record,schema,want", [
    ('{"rule": "scan", "source": {"ip": "10.0.0.1", "o\'port": 22.0}, "score": 9.5, "seen": 3.0, "state": null, "tags": ["a", "b"]}', ALERT, []),
    ("{" + SOURCE + "}", ALERT, ["required:rule"]),
    ('{"rule": "scan", "source": {"o\'port": 1.5}, "zzz": 1, "aaa": 2}', ALERT, ["additional:aaa", "additional:zzz", "required:source.ip", "type:source.o'port"]),
    ('{"rule": null, "source": []}', ALERT, ["type:rule", "type:source"]),
    ('{"rule": "X", ' + SOURCE + "}", ALERT, ["minLength:rule", "pattern:rule"]),
    ('{"rule": "\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9\u00e9", ' + SOURCE + "}", ALERT, ["maxLength:rule", "pattern:rule"]),
    ('{"rule": "ab", "score": 0, ' + SOURCE + "}", ALERT, ["exclusiveMinimum:score"]),
    ('{"rule": "ab", "score": 10.25, ' + SOURCE + "}", ALERT, ["maximum:score", "multipleOf:score"]),
    ('{"rule": "ab", "seen": 1.5, "state": "gone", ' + SOURCE + "}", ALERT, ["enum:state", "type:seen"]),
    ('{"rule": "ab", "seen": "1", "state": 7.0, ' + SOURCE + "}", ALERT, ["type:seen"]),
    ('{"rule": "ab", "tags": [], ' + SOURCE + "}", ALERT, ["minItems:tags"]),
    ('{"rule": "ab", "tags": ["a", 1, "a", null], ' + SOURCE + "}", ALERT, ["maxItems:tags", "type:tags[1]", "type:tags[3]", "uniqueItems:tags"]),
    ('{"rule": "ab", "path": [[{"hop": 1}], [{}, {"hop": 0}, {"hop": "x"}]], ' + SOURCE + "}", ALERT, ["minimum:path[1][1].hop", "type:path[1][2].hop"]),
    ('{"original": {"a": [1.0, 2]}, "more": true}', OPEN, []),
    ('{"original": {"a": [2, 1]}, "more": 1, "far_too_long": false}', OPEN, ["const:original", "maxProperties:$", "propertyNames:far_too_long", "type:more"]),
    ("{}", OPEN, ["minProperties:$"]),
    ('{"v": 7, "w": 1, "x": "s", "y": 3, "z": [2], "no": 1}', CHOICE, ["anyOf:w", "contains:z", "false:no", "maximum:y", "not:x", "oneOf:v"]),
    ('{"v": 5.5, "w": null, "x": 1, "y": 1.5, "z": [2, 1]}', CHOICE, []),
    ('{"any": 1}', {}, []),
    ("[1, 2]", ALERT, ["type:$"]),
    ("{oops", ALERT, ["type:$"]),
    (None, ALERT, ["type:$"]),
])
def test_validation(spark, record, schema, want):
    assert errors(spark, record, schema) == want


@pytest.mark.parametrize("schema", [
    {"properties": {"a": {"format": "email"}}}, {"patternProperties": {}}, {"properties": {"a": {"type": "text"}}}, {"items": [{}, {}]},
    {"properties": {"a": {"minLength": -1}}}, {"properties": {"a": {"minimum": "1"}}}, {"additionalProperties": {"if": {}}}, {"enum": "abc"},
])
def test_unknown_keywords_are_refused(spark, schema):
    with pytest.raises(SchemaError):
        Q.validate(spark.createDataFrame([], "j string"), "j", schema)


def test_missing_required(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": null, "b": 1, "c": 1}',)], "j string")
    got = [r[0] for r in df.select(Q.missing_required(F.col("j"), ["a", "b", "c"])).collect()]
    assert got == [["b", "c"], []]
    assert df.select(Q.missing_required(F.col("j"), [])).first()[0] == []


def test_store_split(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1), None), (2, None, None), (None, None, "{bad")],
                               "id long, timestamp timestamp_ntz, _corrupt string")
    good, bad, counts = W.store_split(df, scratch_path(spark, "split"))
    assert counts == {"good": 1, "quarantine": 2}
    assert [r.id for r in good.collect()] == [1] and sorted(str(r.id) for r in bad.collect()) == ["2", "None"]
    assert good.columns == ["id", "timestamp"] and bad.columns == df.columns


def test_gate(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert Q.gate(df, F.col("x") > 5).count() == 3
    with pytest.raises(Q.QualityError):
        Q.gate(df, F.col("x") > 1)
    assert Q.gate(df, F.col("x") > 1, limit=1).count() == 3


def test_secret_gate(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "password=hunter2hunter2")], "id long, text string")
    assert Q.secret_gate(df.where("id = 1"), "id", "text").count() == 1
    with pytest.raises(Q.QualityError, match="assignment in 1 records") as err:
        Q.secret_gate(df, "id", "text")
    assert "hunter2" not in str(err.value)


def test_policy_check(spark):
    df = spark.createDataFrame([(90,), (30,), (0,), (-1,), (None,)], "retention_days int")
    assert [r.result for r in Q.policy_check(df).collect()] == ["pass", "warn", "warn", "warn", "warn"]


def test_status_diff(spark):
    a = spark.createDataFrame([("x", "PASS", 1), ("x", "FAIL", 2), ("gone", "PASS", 1)], "name string, status string, seq int")
    b = spark.createDataFrame([("x", "PASS", 1), ("new", "WARN", 1)], "name string, status string, seq int")
    assert [tuple(r) for r in C.status_diff(a, b, "seq").collect()] == [
        ("gone", "PASS", "N/A"), ("new", "N/A", "WARN"), ("x", "FAIL", "PASS")]
    assert C.status_diff(a, a, "seq").isEmpty()


def test_verify_all(spark):
    def verdict(rows):
        return C.verify_all(spark.createDataFrame(rows, "is_synced boolean")).first()[0]
    assert verdict([]) is True
    assert verdict([(True,), (True,)]) is True
    assert verdict([(True,), (False,)]) is False
    assert verdict([(True,), (None,)]) is False


def test_content_hash(spark):
    make = lambda rows: spark.createDataFrame(rows, "g string, a string, b string")
    h = lambda rows: C.content_hash(make(rows), ["g"]).first().content_hash
    base = [("g", "1", "2"), ("g", None, "3")]
    assert h(base) == h(base[::-1])
    assert h(base) != h(base + base[:1])
    assert h([("g", "a", None)]) != h([("g", None, "a")])
    assert h([("g", "a|b", "c")]) != h([("g", "a", "b|c")])
    rec = C.reconcile(make(base + [("only", "x", "y")]), make(base), ["g"])
    assert {r.g: r.is_synced for r in rec.collect()} == {"g": True, "only": False}
    nulls = [(None, "1", "2"), ("g", "1", "2")]
    rec = C.reconcile(make(nulls), make(nulls), ["g"])
    assert [(r.g, r.is_synced) for r in rec.orderBy("g").collect()] == [(None, True), ("g", True)]
    h_all = C.content_hash(make(nulls), ["g"])
    assert C.manifest_mismatches(h_all, h_all, ["g"]).isEmpty()
    assert [r.g for r in C.manifest_mismatches(h_all, h_all.where("g = 'g'"), ["g"]).collect()] == [None]


def test_resample_fills_gaps(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 30),), (datetime(2024, 1, 1, 3, 59),), (None,)], "ts timestamp_ntz")
    assert [(r.bucket.hour, r.n) for r in A.resample_hourly(df).orderBy("bucket").collect()] == [(0, 1), (1, 0), (2, 0), (3, 1)]
    assert A.resample_hourly(df.where("false")).isEmpty()


def test_counts_and_null_rules(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "k string")
    assert [tuple(r) for r in A.value_counts(df, "k", 1).collect()] == [("a", 1)]
    assert [tuple(r) for r in A.group_counts(df, "k", 1).collect()] == [(None, 3)]
    assert A.group_size(df, "k").count() == 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    assert [tuple(r) for r in A.histogram(df, "v", 10).orderBy("bin").collect()] == [(i, 1) for i in range(1, 10)] + [(10, 2)]
    assert [tuple(r) for r in A.histogram(df.where("v = 3"), "v", 10).collect()] == [(1, 1)]
    assert A.histogram(df.where("false"), "v").isEmpty()


def test_user_profile_ignores_nulls(spark):
    df = spark.createDataFrame([("u", "e", "1"), ("u", None, "1"), ("u", "e", None), ("n", None, None)],
                               "user_id string, event_type string, source_ip string")
    assert data(A.user_profile(df)) == sorted([(1, 2, "u"), (0, 0, "n")], key=repr)
    assert data(A.user_profile(df, approximate=True)) == data(A.user_profile(df))


def test_session_gap_is_strict(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t, "u"), (2, t + timedelta(seconds=60), "u"), (3, t + timedelta(seconds=121), "u")],
                               "event_id long, ts timestamp_ntz, user_id string")
    assert D.user_sessions(df, gap_seconds=60).count() == 2


def test_burst_counts_peers_and_bounds(spark):
    t = datetime(2024, 1, 1)
    at = [0, 600, 600, 1201]
    df = spark.createDataFrame([(i, t + timedelta(seconds=s), "s") for i, s in enumerate(at)],
                               "event_id long, ts timestamp_ntz, source_ip string")
    got = {r.event_id: r.n_failures for r in D.burst_detect(df, maxretry=1).collect()}
    assert got == {0: 1, 1: 3, 2: 3, 3: 1}


def test_filters(spark):
    df = spark.createDataFrame([("PowerShell.exe", "a"), ("powershell", "b"), (None, "c")], "p string, k string")
    assert df.where(P.contains_like(F.col("p"), "%powershell%")).count() == 1
    assert df.where(P.contains_like(F.col("p"), "%powershell%", ignore_case=True)).count() == 2
    assert P.where_all(df, p=None, k="a").count() == 1
    allow = spark.createDataFrame([("a", True), ("b", False)], "n string, enabled boolean")
    assert P.allowed(df, "k", allow, "n").count() == 1
    assert P.allowed(df, "k", allow, "n", override=["b", "c"]).count() == 2


def test_attack_rules_give_one_row_per_match(spark):
    df = spark.createDataFrame([("cmd.exe /c powershell",), ("calc",), (None,)], "process_name string")
    assert sorted(r.technique for r in D.attack_map(df).collect()) == ["T1059.001", "T1059.003"]


def test_retention(spark):
    as_of = datetime(2024, 4, 1)
    df = spark.createDataFrame([(1, as_of - timedelta(days=90)), (2, as_of - timedelta(days=90, seconds=1)), (3, None)],
                               "id int, timestamp timestamp_ntz")
    assert sorted(r.id for r in T.retention_keep(df, as_of, days=90).collect()) == [1, 3]
    assert T.retention_keep(df, as_of, 90).count() + df.where(T.expired("timestamp", as_of, 90)).count() == 3
    both = df.withColumn("created_date", F.col("timestamp"))
    assert T.time_column(both) == "timestamp" and T.time_column(both.withColumn("created_at", F.col("id"))) == "created_at"
    report = T.retention_report({"t": df, "cleanup_log": df, "none": spark.range(3)}, {}, as_of)
    assert [(r.table_name, r.rows_deleted, r.retention_days) for r in report.collect()] == [("t", 1, 90)]
    assert T.log_rows(report, enabled=False).isEmpty() and T.log_rows(report).count() == 1


def test_clean_partitioned_table(spark):
    path = scratch_path(spark, "clean")
    start = datetime(2024, 1, 1)
    df = spark.range(240).select("id", (F.lit(start) + F.make_dt_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("timestamp")) \
        .withColumn("event_date", F.to_date("timestamp"))
    df.write.partitionBy("event_date").parquet(path)
    as_of = datetime(2024, 1, 5, 12) + timedelta(days=30)
    want = T.retention_keep(df, as_of, days=30).count()
    assert T.clean_partitioned(spark, path, as_of, 30) == 240 - want
    left = spark.read.parquet(path)
    assert left.count() == want and left.agg(F.min("event_date")).first()[0] == date(2024, 1, 5)
    assert T.clean_partitioned(spark, path, as_of, 30) == 0


def test_policy_needs_no_entry_with_a_floor(spark):
    policy = spark.createDataFrame([("log", "a", 30), ("log", "default", 120)], "kind string, subject string, retention_days int")
    targets = spark.createDataFrame([("log", "a"), ("log", "b"), ("other", "a")], "kind string, subject string")
    got = {(r.kind, r.subject): r.retention_days for r in T.resolve_policy(targets, policy).collect()}
    assert got == {("log", "a"): 30, ("log", "b"): 120, ("other", "a"): None}
    got = {(r.kind, r.subject): r.retention_days for r in T.resolve_policy(targets, policy, floor=90).collect()}
    assert got == {("log", "a"): 90, ("log", "b"): 120, ("other", "a"): 90}


def test_deanonymize_rules(spark):
    t = datetime(2024, 1, 1, 12)
    maps = V.new_mappings(spark.createDataFrame([("ann", "user"), ("ann", "user"), (None, "user")], "original string, field_type string"),
                          spark.createDataFrame([], "anonymized_value string, field_type string"), "s", KEY, "2024-01-01")
    assert maps.count() == 1
    mask = maps.first().anonymized_value
    ask = [(1, "adm", mask, t), (2, "two", mask, t), (3, "two", mask, t + timedelta(seconds=3599)), (4, "two", mask, t + timedelta(seconds=3600)),
           (5, "new", mask, t), (6, "two", "user_unknown", t), (7, "two", mask, t - timedelta(seconds=1))]
    req = spark.createDataFrame([(i, u, "user", m, "why", ts) for i, u, m, ts in ask],
                                "request_id long, user string, field_type string, anonymized_value string, reason string, req_ts timestamp_ntz")
    levels = spark.createDataFrame([("adm", None, 3), ("two", "user", 2)], "user string, field_type string, level int")
    appr = spark.createDataFrame([("two", "user", mask, t), ("two", "user", "user_unknown", t)],
                                 "user string, field_type string, anonymized_value string, appr_ts timestamp_ntz")
    for hot_rows in (10**9, 2):
        out = V.deanonymize(req, maps, levels, appr, KEY, hot_rows=hot_rows)
        got = {r.request_id: (r.reason_code, r.revealed, r.original_value) for r in out.collect()}
        assert got == {
            1: ("level3", True, "ann"), 2: ("approved", True, "ann"), 3: ("approved", True, "ann"), 4: ("expired", False, None),
            5: ("level1", False, None), 6: ("approved", False, None), 7: ("not_approved", False, None)}
        assert V.deanonymization_audit(out).count() == 7
    again = V.new_mappings(spark.createDataFrame([("ann", "user"), ("bob", "user")], "original string, field_type string"), maps, "s", KEY, "2024-01-02")
    assert again.count() == 1


def test_playbook_rules(spark, sf):
    with pytest.raises(ValueError):
        B.Playbook("x", "no-such-tactic", "hypothesis", "", lambda e, p: e)
    late = B.Playbook("late", "discovery", "model", "fails while running",
                      lambda e, p: e.select(F.col("user_id").alias("entity"), "ts", F.raise_error(F.lit("boom")).cast("string").alias("detail")))
    good = B.Playbook("good", "discovery", "baseline", "", lambda e, p: B.scope(e, p).limit(3).select(
        F.col("user_id").alias("entity"), "ts", F.lit("d").alias("detail")))
    out = B.run_playbooks(spark, events(spark, sf), [late, good], B.Params(start="2024-01-02"))
    assert {(r.playbook, r.status): r["count"] for r in out.groupBy("playbook", "status").count().collect()} == \
        {("late", "error"): 1, ("good", "ok"): 3}


def test_baseline_and_model_playbooks(spark, sf):
    books = [B.baseline_hunt("t-base", "discovery", "odd days", limit=1.0),
             B.model_hunt("t-model", "exfiltration", "odd users", ["n_click", "n_error"], quantile=0.8)]
    out = B.run_playbooks(spark, events(spark, sf), books, B.Params())
    assert {(r.playbook, r.status) for r in out.select("playbook", "status").distinct().collect()} == {("t-base", "ok"), ("t-model", "ok")}


def test_stored_events_are_pruned(spark, sf):
    path = scratch_path(spark, "stored")
    W.write_events(events(spark, sf), path, "ts")
    day = P.between(spark.read.parquet(path), "ts", "2024-01-05", "2024-01-06", partition_date="event_date")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(ts" in plan
    want = P.between(events(spark, sf), "ts", "2024-01-05", "2024-01-06").count()
    assert day.count() == want > 0


def test_append_and_read_back(spark):
    path = scratch_path(spark, "probe")
    df = spark.range(10)
    assert tuple(W.append_verify(df, path, "b1").first()) == ("b1", 10, 10, True)
    assert tuple(W.append_verify(df.limit(4), path, "b2").first()) == ("b2", 4, 4, True)
    assert spark.read.parquet(path).count() == 14


def test_check_result_documents(spark, tmp_path):
    doc = """{"timestamp": "2024-01-15T10:30:00+00:00", "hostname": "vm01", "config_file": "c.yml",
      "summary": {"passed": 1, "failed": 0, "warnings": 1, "total": 2}, "vm_ips": {"vm01": "10.0.0.10"},
      "tests": [{"name": "Ping", "status": "PASS"}, {"name": "Port", "status": "WARN"}]}"""
    (tmp_path / "connections_20240115_103000.json").write_text(doc)
    (tmp_path / "connections_20240115_113000.json").write_text(doc.replace("PASS", "FAIL"))
    import os
    os.utime(tmp_path / "connections_20240115_103000.json", (1, 1))
    res = W.read_check_results(spark, str(tmp_path)).withColumn("prefix", F.split_part("file_name", F.lit("_"), F.lit(1)))
    new = W.latest_result(res)
    assert new.first().file_name == "connections_20240115_113000.json" and new.first().vm_ips == {"vm01": "10.0.0.10"}
    assert data(W.explode_tests(new)) == [("Ping", "FAIL"), ("Port", "WARN")]


def test_snapshots(spark, tmp_path):
    import os
    for name in ("backup_vm01_central_20240101_000000.enc", "backup_vm02_vm_specific_20240201_000000.enc", "x.txt"):
        (tmp_path / name).write_text("abc")
    os.utime(tmp_path / "backup_vm01_central_20240101_000000.enc", (0, 0))
    files = S.snapshot_files(spark, str(tmp_path))
    inv = [tuple(r) for r in S.snapshot_inventory(files).collect()]
    assert [r[0] for r in inv] == ["backup_vm02_vm_specific_20240201_000000.enc", "backup_vm01_central_20240101_000000.enc"]
    assert inv[0][1:] == ("vm02", "vm_specific", "20240201_000000", 3)
    assert S.snapshot_inventory(files, config_type="central").count() == 1
    old = S.expired_snapshots(files, F.lit(datetime(2000, 1, 1)), 1)
    assert [r.vm_id for r in old.collect()] == ["vm01"]
    assert S.delete_files(spark, [r.path for r in old.collect()]) == 1
    assert S.snapshot_inventory(S.snapshot_files(spark, str(tmp_path))).count() == 1


def test_collect_continues(spark):
    from pyspark.sql import types as Ty
    schema = Ty.StructType().add("a", "long")
    path = scratch_path(spark, "src")
    spark.range(3).selectExpr("id AS a").write.json(path)
    df, status = R.collect_sources(spark, [R.Source("x", path + "-none", "json", schema), R.Source("bad", path, "zip"), R.Source("y", path, "json", schema)])
    assert df.count() == 3 and {r.source: r.status for r in status.collect()} == {"x": "failed", "bad": "failed", "y": "ok"}
    none, status = R.collect_sources(spark, [R.Source("x", path + "-none", "json", schema)])
    assert none is None and status.count() == 1


def test_event_xml_files(spark, tmp_path):
    (tmp_path / "e.xml").write_text(
        "<Events><Event><System><EventID>4624</EventID></System></Event>\n<Event><System>\n<EventID>4625</EventID></System></Event></Events>")
    df = R.scan_winevent_files(spark, str(tmp_path / "e.xml"), "System struct<EventID: int>")
    assert sorted(r.id for r in df.select(F.col("System.EventID").alias("id")).collect()) == [4624, 4625]


def test_masked_groups_equal_clear_groups(spark, sf):
    from huntlake.functions.masking import mask_ip
    ev = events(spark, sf)
    clear = sorted(r.n for r in A.group_size(ev, "source_ip").collect())
    masked = sorted(r.n for r in A.group_size(ev.withColumn("source_ip", mask_ip(F.col("source_ip"), "s")), "source_ip").collect())
    assert clear == masked


def test_model_flags_the_odd_one(spark):
    rows = [(f"u{i}", 100.0 * (i % 2) + i % 5, 1.0 + i % 3) for i in range(199)] + [("odd", 100.0, 12.0)]
    df = spark.createDataFrame(rows, "user_id string, a double, b double")
    assert [r.user_id for r in D.model_anomaly(df, "user_id", ["a", "b"], k=2).collect()] == ["odd"]
