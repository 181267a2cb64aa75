"""Collection, parsing and normalization."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.functions import parse as X
from huntlake.operators import normalize as N
from huntlake.sources import custom as C
from huntlake.sources import readers as R
from huntlake.sources import sinks as W
from huntlake.sources import staging as G
from huntlake.plans.sizes import local_rows
from huntlake.session import scratch_path
from huntlake.suite.base import EV, ev_sql, events, query, table
from huntlake.suite.hunting import CHECKS, checks

RAW = T.StructType().add("event_id", "long").add("ts", "string").add("user_id", "string") \
    .add("event_type", "string").add("value", "double")


def _bad(n: int = 97):
    return F.col("event_id") % n == 0


def _json_line():
    return F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value"))


def _write_lines(df, spark, name, line):
    path = scratch_path(spark, name)
    df.select(line.alias("value")).write.text(path)
    return path


@query("scan_json", ev_sql("""
SELECT event_id, ts, user_id, event_type, value FROM ev WHERE event_id % 97 <> 0"""))
def scan_json(spark, sf):
    line = F.when(_bad(), F.lit('{"event_id": 1, broken')).otherwise(_json_line())
    path = _write_lines(events(spark, sf), spark, "json", line)
    df = R.scan_json(spark, path, RAW)
    return X.convert_types(df.where(F.col("_corrupt").isNull()).drop("_corrupt"), {"ts": "timestamp"})


@query("scan_csv", ev_sql("SELECT event_id, ts, user_id, process_name, file_path FROM ev"))
def scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    ev = events(spark, sf).select("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "process_name", "file_path")
    W.write_result(ev, path, "csv")
    schema = T.StructType().add("event_id", "long").add("ts", "string").add("user_id", "string") \
        .add("process_name", "string").add("file_path", "string")
    df = R.scan_csv(spark, path, schema)
    return X.convert_types(df.where(F.col("_corrupt").isNull()).drop("_corrupt"), {"ts": "timestamp"})


@query("parse_syslog", ev_sql(r"""
SELECT CAST((event_id % 192) // 8 AS INTEGER) AS facility, CAST(event_id % 8 AS INTEGER) AS severity,
       date_trunc('second', ts) AS ts, source_system AS host, process_name AS app,
       CAST(event_id AS VARCHAR) AS pid, CASE WHEN event_id % 2 <> 0 THEN 'ID47' END AS msg_id,
       CASE WHEN event_id % 2 <> 0 THEN '[a@1 k="x\]y"]' END AS structured_data, 'user ' || user_id || ' did: ' || event_type AS message FROM ev"""))
def parse_syslog(spark, sf):
    c = F.col
    pri = F.concat(F.lit("<"), (c("event_id") % 192).cast("string"), F.lit(">"))
    msg = F.concat(F.lit("user "), c("user_id"), F.lit(" did: "), c("event_type"))
    old = F.concat(pri, F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" "), c("source_system"), F.lit(" "), c("process_name"),
                   F.lit("["), c("event_id").cast("string"), F.lit("]: "), msg)
    new = F.concat(pri, F.lit("1 "), X.iso_stamp(c("ts")), F.lit(" "), c("source_system"), F.lit(" "), c("process_name"),
                   F.lit(" "), c("event_id").cast("string"), F.lit(r' ID47 [a@1 k="x\]y"] '), msg)
    path = _write_lines(events(spark, sf), spark, "syslog", F.when(c("event_id") % 2 == 0, old).otherwise(new))
    return X.parse_syslog(R.scan_lines(spark, path), year=2024).drop("line")


@query("parse_winevent", ev_sql("""
SELECT ts, 'Security-' || source_system AS provider, CAST(4600 + event_id % 100 AS INTEGER) AS event_code,
       destination_ip AS host, user_id AS target_user, process_name FROM ev"""))
def parse_winevent(spark, sf):
    xml = F.format_string(
        "<Event><System><Provider Name='Security-%s'/><EventID>%d</EventID><TimeCreated SystemTime='%s'/>"
        "<Computer>%s</Computer></System><EventData><Data Name='TargetUserName'>%s</Data>"
        "<Data Name='NewProcessName'>%s</Data></EventData></Event>",
        "source_system", F.col("event_id") % 100 + 4600, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "destination_ip", "user_id", "process_name")
    path = _write_lines(events(spark, sf), spark, "winevent", xml)
    df = R.scan_winevents(spark, path)
    return df.select("ts", "provider", "event_code", "host", F.col("data")["TargetUserName"].alias("target_user"),
                     F.col("data")["NewProcessName"].alias("process_name"))


@query("parse_custom", ev_sql("""
SELECT event_id, user_id, process_name, 'a=b' AS note FROM ev"""))
def parse_custom(spark, sf):
    line = F.concat(F.lit("user="), F.col("user_id"), F.lit(";proc="), F.col("process_name"), F.lit("; note=a=b;noise"))
    df = X.parse_custom(events(spark, sf).select("event_id", line.alias("line")), "kv")
    return df.select("event_id", *[F.col("fields")[k].alias(n) for k, n in
                                   (("user", "user_id"), ("proc", "process_name"), ("note", "note"))])


@query("parse_pglog", ev_sql("""
SELECT date_trunc('second', ts) AS ts, CAST(1000 + event_id AS INTEGER) AS pid, user_id, 'hunt' AS db, process_name AS app,
       source_ip AS client, CASE WHEN event_type = 'error' THEN 'FATAL' ELSE 'LOG' END AS level,
       event_type = 'error' AS failed FROM ev"""))
def parse_pglog(spark, sf):
    err = F.col("event_type") == "error"
    client = F.when(F.col("event_id") % 2 == 0, "client=").otherwise("host=")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC ["), (F.col("event_id") + 1000).cast("string"),
        F.lit("]: [3-1] user="), F.col("user_id"), F.lit(",db=hunt,app="), F.col("process_name"), F.lit(","), client,
        F.col("source_ip"), F.when(err, " FATAL").otherwise(" LOG"), F.lit(":  "),
        F.when(err, "password authentication failed").otherwise("connection authorized"))
    path = _write_lines(events(spark, sf), spark, "pglog", line)
    df = X.parse_pglog(R.scan_lines(spark, path))
    return df.select("ts", "pid", "user_id", "db", "app", "client", "level", X.failed_login(F.col("message")).alias("failed"))


def _audit_lines(ev):
    c = F.col
    line = X.format_audit(
        c("user_id"), c("source_system"), F.concat(F.lit("ls | grep "), c("process_name")), c("ts"),
        c("ts") + F.make_dt_interval(secs=c("event_id") % 50), F.when(c("event_type") == "error", "error").otherwise("success"),
        (c("event_id") % 3).cast("int"),
        F.create_map(F.lit("password"), F.lit("hunter2"), F.lit("k"), c("event_type"), F.lit("Secret"), F.lit("kept")))
    return ev.select("event_id", line.alias("line"))


@query("audit_parse", ev_sql("""
SELECT event_id, user_id, source_system AS vm_id, 'ls | grep ' || process_name AS operation,
       date_trunc('second', ts) AS start, date_trunc('second', ts + to_seconds(CAST(event_id % 50 AS INTEGER))) AS "end",
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, CAST(event_id % 3 AS INTEGER) AS exit_code,
       'Secret=kept,k=' || event_type AS extra FROM ev"""))
def audit_parse(spark, sf):
    df = X.parse_audit(_audit_lines(events(spark, sf)))
    pairs = F.transform(F.sort_array(F.map_keys("extra")), lambda k: F.concat(k, F.lit("="), F.col("extra")[k]))
    return df.drop("line").withColumn("extra", F.array_join(pairs, ","))


@query("redact_map", ev_sql("""
SELECT event_id, 'Password,host' AS keys FROM ev"""))
def redact_map(spark, sf):
    extra = F.create_map(*[x for k in ("password", "key", "secret", "Password", "host") for x in (F.lit(k), F.col("user_id"))])
    kept = X.redact_map(extra)
    return events(spark, sf).select("event_id", F.array_join(F.sort_array(F.map_keys(kept)), ",").alias("keys"))


@query("truncate_text", r"""
SELECT doc_id, substring(text, 1, 200) AS head200, substring(text, 1, 80) AS head80,
       trim(split_part(text, chr(10), 1)) AS first_line FROM documents""")
def truncate_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.truncate_text(t, 200).alias("head200"),
                                                X.truncate_text(t, 80).alias("head80"), X.first_line(t).alias("first_line"))


@query("detect_format", ev_sql("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'json' WHEN 1 THEN 'winevent' WHEN 2 THEN 'syslog' WHEN 3 THEN 'audit'
       WHEN 4 THEN 'csv' ELSE 'unknown' END AS format FROM ev"""))
def detect_format(spark, sf):
    kind = F.col("event_id") % 6
    line = (
        F.when(kind == 0, _json_line()).when(kind == 1, F.concat(F.lit("<Event><System/>"), F.col("user_id"), F.lit("</Event>")))
        .when(kind == 2, F.concat(F.lit("<13>Jan 5 00:00:00 h a: "), F.col("user_id")))
        .when(kind == 3, F.concat(F.lit("user_id="), F.col("user_id"), F.lit(" | vm_id=x | status=ok")))
        .when(kind == 4, F.concat_ws(",", "user_id", "event_type")).otherwise(F.col("user_id")))
    return events(spark, sf).select("event_id", X.detect_format(line).alias("format"))


@query("extract_fields", ev_sql("""
SELECT event_id, user_id, process_name, value FROM ev"""))
def extract_fields(spark, sf):
    doc = F.to_json(F.struct(F.struct(F.col("user_id").alias("name")).alias("user"),
                             F.concat(F.lit("proc="), F.col("process_name"), F.lit(" done")).alias("msg"), "value"))
    df = events(spark, sf).select("event_id", doc.alias("line"))
    out = X.extract_fields(df, "line", {"user_id": ("json", "$.user.name"), "value": ("json", "$.value"),
                                        "process_name": ("regex", r"proc=([^ ]+) done", 1)})
    return X.convert_types(out.drop("line"), {"value": "double"})


@query("convert_types", ev_sql("""
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value,
       CASE WHEN event_id % 89 = 0 THEN NULL ELSE ts END AS ts, CAST(event_id % 1000 AS INTEGER) AS code FROM ev"""))
def convert_types(spark, sf):
    text = events(spark, sf).select(
        "event_id", F.when(_bad(), "oops").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(_bad(89), "2024-13-45").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("ts"),
        (F.col("event_id") % 1000).cast("string").alias("code"))
    return X.convert_types(text, {"value": "double", "ts": "timestamp", "code": "int"})


@query("quarantine", ev_sql("""
SELECT CASE WHEN event_id % 97 = 0 THEN 'unreadable' WHEN event_id % 89 = 0 THEN 'no timestamp' ELSE 'good' END AS part,
       count(*) AS n FROM ev GROUP BY 1"""))
def quarantine(spark, sf):
    doc = F.to_json(F.struct("event_id", F.when(~_bad(89), F.col("ts").cast("string")).alias("ts"), "user_id"))
    path = _write_lines(events(spark, sf), spark, "quarantine", F.when(_bad(), F.lit("<<not json")).otherwise(doc))
    df = X.convert_types(R.scan_json(spark, path, RAW), {"ts": "timestamp"})
    good, bad, _ = W.store_split(df, scratch_path(spark, "split"), timestamp="ts")
    why = F.when(F.col("_corrupt").isNotNull(), "unreadable").otherwise("no timestamp")
    both = good.select(F.lit("good").alias("part"), "event_id").unionByName(bad.select(why.alias("part"), "event_id"))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("json_or_raw", ev_sql("""
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE WHEN event_id % 97 = 0 THEN 'plain ' || user_id END AS raw FROM ev"""))
def json_or_raw(spark, sf):
    line = F.when(_bad(), F.concat(F.lit("plain "), F.col("user_id"))).otherwise(_json_line())
    m = X.json_or_raw(line)
    return events(spark, sf).select("event_id", m["user_id"].alias("user_id"), m["_raw"].alias("raw"))


MAPPING = {f: f for f in ("source_system", "event_type", "source_ip", "destination_ip", "user_id", "process_name", "file_path")}


@query("normalize", ev_sql("""
SELECT event_id, ts AS timestamp, source_system, event_type, source_ip, destination_ip, user_id, process_name,
       CAST(NULL AS VARCHAR) AS command_line, file_path, CAST(value AS VARCHAR) AS extra_value FROM ev"""))
def normalize(spark, sf):
    df = N.normalize(events(spark, sf), {"timestamp": "ts", **MAPPING}, keep=["event_id"])
    return df.select("event_id", "timestamp", "source_system", "event_type", "source_ip", "destination_ip", "user_id",
                     "process_name", "command_line", "file_path", F.col("extra")["value"].alias("extra_value"))


@query("standardize", ev_sql("""
SELECT event_id, CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'access' ELSE event_type END AS event_type,
       process_name FROM ev"""))
def standardize(spark, sf):
    messy = events(spark, sf).select(
        "event_id", F.concat(F.lit(" "), F.upper("event_type"), F.lit("  ")).alias("event_type"), F.upper("process_name").alias("process_name"))
    words = local_rows(spark, [("event_type", "error", "failure"), ("event_type", "view", "access")],
                       "field string, raw string, standard string")
    return N.standardize(messy, ["event_type", "process_name"], words)


@query("defaults_flags", ev_sql("""
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unknown' ELSE event_type END AS event_type,
       CASE WHEN event_id % 13 = 0 THEN 'unknown' ELSE source_system END AS source_system,
       concat_ws(',', CASE WHEN event_id % 89 = 0 THEN 'bad_timestamp' END, CASE WHEN event_id % 13 = 0 THEN 'missing_source_system' END,
                 CASE WHEN event_id % 11 = 0 THEN 'missing_event_type' END) AS flags FROM ev"""))
def defaults_flags(spark, sf):
    holes = events(spark, sf).select(
        "event_id", F.when(~_bad(89), F.col("ts")).alias("ts"), F.when(~_bad(11), F.col("event_type")).alias("event_type"),
        F.when(_bad(13), "").otherwise(F.col("source_system")).alias("source_system"), "source_ip", "user_id")
    df = N.apply_defaults(holes, timestamp="ts")
    return df.select("event_id", "event_type", "source_system", F.array_join("quality_flags", ",").alias("flags"))


@query("pii_flag", ev_sql("""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'source_ip,destination_ip,user_id,command_line'
                      ELSE 'source_ip,destination_ip,user_id' END AS pii_fields, FALSE AS anonymized FROM ev"""))
def pii_flag(spark, sf):
    ev = events(spark, sf).withColumn("cmd", F.when(F.col("event_id") % 7 == 0, "someone@example.com").otherwise("whoami"))
    df = N.prepare_events(ev, {"timestamp": "ts", **MAPPING, "command_line": "cmd"}, keep=["event_id"])
    return df.select("event_id", F.array_join("metadata.pii_fields", ",").alias("pii_fields"),
                     F.col("metadata.anonymized").alias("anonymized"))


@query("collect_batch", ev_sql("""
SELECT event_id, ts AS timestamp, event_type, user_id FROM ev"""))
def collect_batch(spark, sf):
    path = scratch_path(spark, "landing")
    events(spark, sf).select("event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value") \
        .write.json(path)
    raw = R.read_source(spark, R.Source("edr", path, "json", RAW)).drop("_corrupt")
    df = N.normalize(raw, {"timestamp": "ts", "event_type": "event_type", "user_id": "user_id"}, keep=["event_id"])
    return df.select("event_id", "timestamp", "event_type", "user_id")


@query("collect_multi", ev_sql("""
SELECT CASE source_system WHEN 'src_0' THEN 'edr' WHEN 'src_1' THEN 'siem' ELSE 'lake' END AS collected_from, event_id, user_id,
       CASE WHEN source_system = 'src_1' THEN NULL ELSE event_type END AS event_type FROM ev"""))
def collect_multi(spark, sf):
    ev = events(spark, sf)
    base = scratch_path(spark, "multi")
    of = lambda s, *cols: ev.where(F.col("source_system") == s).select(*cols)
    of("src_0", "event_id", "user_id", "event_type").write.json(base + "/edr")
    W.write_result(of("src_1", "event_id", "user_id"), base + "/siem", "csv")
    of("src_2", "event_id", "user_id", "event_type").write.parquet(base + "/lake")
    wide = T.StructType().add("event_id", "long").add("user_id", "string").add("event_type", "string")
    df, _ = R.collect_sources(spark, [
        R.Source("edr", base + "/edr", "json", wide),
        R.Source("gone", base + "/gone", "json", wide),
        R.Source("siem", base + "/siem", "csv", T.StructType(wide.fields[:2])),
        R.Source("lake", base + "/lake", "parquet", wide),
    ])
    return df.select("collected_from", "event_id", "user_id", "event_type")


@query("collect_status", ev_sql("""
SELECT 'edr' AS source, 'ok' AS status, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS merged FROM ev
UNION ALL SELECT 'siem', 'ok', count(*), count(*) FROM ev WHERE event_type = 'error'
UNION ALL SELECT 'gone', 'failed', 0, 0 UNION ALL SELECT 'corrupt', 'failed', 0, 0"""))
def collect_status(spark, sf):
    base, ev = scratch_path(spark, "status"), events(spark, sf)
    ev.select("event_id", "user_id").write.json(base + "/edr")
    ev.where("event_type = 'error'").select("event_id", "ts").write.parquet(base + "/siem")
    # readable as a listing, not as Parquet: fails only when rows are asked for
    ev.select(F.col("user_id").alias("value")).write.text(base + "/corrupt")
    schema = T.StructType().add("event_id", "long").add("user_id", "string")
    df, report = G.collect_staged(spark, [
        R.Source("edr", base + "/edr", "json", schema), R.Source("gone", base + "/gone", "json", schema),
        R.Source("corrupt", base + "/corrupt", "parquet", schema), R.Source("siem", base + "/siem", "parquet"),
    ], base + "/stage")
    per = df.groupBy(F.col("collected_from").alias("source")).agg(F.count("event_id").alias("merged"))
    return report.select("source", "status", "n").join(F.broadcast(per), "source", "left").withColumn("merged", F.coalesce("merged", F.lit(0)))


@query("scan_custom", ev_sql("""
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS who,
       'seen ' || event_type || chr(10) || '  in ' || file_path AS note FROM ev WHERE event_id % 13 <> 0
UNION ALL SELECT NULL, NULL, 'torn ' || user_id FROM ev WHERE event_id % 13 = 0"""))
def scan_custom(spark, sf):
    """Records of several lines; every thirteenth is torn and comes back whole as raw text."""
    ev, path, c = events(spark, sf), scratch_path(spark, "custom"), F.col
    who = F.when(c("event_id") % 11 == 0, "").otherwise(c("user_id"))
    whole = F.concat(F.lit("== "), c("event_id").cast("string"), F.lit("\nwho: "), who, F.lit("\nnote: seen "), "event_type", F.lit("\n  in "), "file_path")
    block = F.when(c("event_id") % 13 == 0, F.concat(F.lit("== torn "), "user_id")).otherwise(whole)
    ev.select(block.alias("value")).write.text(path)
    df = C.scan_custom(spark, path, "^== ", r"== (?P<id>\d+)\nwho: (?P<who>[^\n]*)\nnote: (?P<note>.*)", rangeBytes="20000")
    return df.select("id", "who", F.coalesce("note", F.substring("raw", 4, 1000)).alias("note"))


@query("scan_table", """
SELECT event_id, user_id, value FROM events WHERE value > 100 AND event_type = 'purchase'""")
def scan_table(spark, sf):
    table(spark, sf, "events")
    return R.scan_table(spark, f"{sf}/events.parquet", ["event_id", "user_id", "value"],
                        (F.col("value") > 100) & (F.col("event_type") == "purchase"))


@query("append_verify", """
SELECT event_type AS batch_id, count(*) AS rows_written, count(*) AS rows_read, TRUE AS ok FROM events
WHERE event_type IN ('error', 'click') GROUP BY 1""")
def append_verify(spark, sf):
    path = scratch_path(spark, "append")
    ev = events(spark, sf)
    first = W.append_verify(ev.where("event_type = 'error'"), path, "error")
    return first.unionByName(W.append_verify(ev.where("event_type = 'click'"), path, "click"))


@query("check_results_read", ev_sql("""
SELECT host AS hostname, name, status, count(*) FILTER (status = 'PASS') OVER (PARTITION BY host) AS passed,
       count(*) OVER (PARTITION BY host) AS total FROM checks""", CHECKS))
def check_results_read(spark, sf):
    path = scratch_path(spark, "checks")
    W.check_documents(checks(events(spark, sf)), "host", "2024-01-31T00:00:00+00:00", "configs/config.yml").write.json(path)
    results = W.read_check_results(spark, path, multiline=False)
    return W.explode_tests(results.withColumns({"passed": F.col("summary.passed"), "total": F.col("summary.total")}),
                           "hostname", "passed", "total")


@query("export_roundtrip", """
SELECT f AS format, event_type, count(*) AS n FROM events, (VALUES ('json'), ('csv')) t(f) GROUP BY 1, 2""")
def export_roundtrip(spark, sf):
    result = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    schema = T.StructType().add("event_type", "string").add("n", "long")
    base = scratch_path(spark, "export")
    W.write_result(result, base + "/json", "json")
    W.write_result(result, base + "/csv", "csv")
    a, b = R.scan_json(spark, base + "/json", schema), R.scan_csv(spark, base + "/csv", schema)
    return a.select(F.lit("json").alias("format"), "event_type", "n").unionByName(
        b.select(F.lit("csv").alias("format"), "event_type", "n"))


@query("export_texts", """
SELECT f AS format, doc_id, sha256(text) AS digest, lang FROM documents, (VALUES ('json'), ('csv')) t(f)""")
def export_texts(spark, sf):
    """Whole texts with line breaks, quotes and separators, written and read back; the CSV by a schema of another order."""
    docs, base = table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), scratch_path(spark, "texts")
    W.write_result(docs, base + "/json", "json")
    W.write_result(docs, base + "/csv", "csv")
    schema = T.StructType().add("lang", "string").add("doc_id", "long").add("text", "string")
    a, b = R.scan_json(spark, base + "/json", schema), R.scan_csv(spark, base + "/csv", schema)
    pick = lambda df, f: df.select(F.lit(f).alias("format"), "doc_id", F.sha2("text", 256).alias("digest"), "lang")
    return pick(a, "json").unionByName(pick(b, "csv"))
