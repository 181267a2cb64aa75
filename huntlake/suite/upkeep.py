"""Retention, snapshots, comparison, reconciliation, audit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from huntlake.functions.parse import compact_stamp, parse_audit
from huntlake.operators import aggregate as A
from huntlake.operators import cleanup as K
from huntlake.operators import compare as C
from huntlake.operators import reconcile as V
from huntlake.operators import retention as T
from huntlake.plans.sizes import small_side
from huntlake.session import scratch_path
from huntlake.sources import snapshots as S
from huntlake.sources.files import Files
from huntlake.sources.sinks import write_events
from huntlake.suite.base import ev_sql, events, query, table
from huntlake.suite.ingest import _audit_lines

AS_OF = datetime(2024, 2, 15)


@query("retention_keep", ev_sql("""
SELECT event_id, ts AS timestamp FROM ev WHERE NOT ts < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY"""))
def retention_keep(spark, sf):
    ev = events(spark, sf).select("event_id", F.col("ts").alias("timestamp"))
    return T.retention_keep(ev, AS_OF, days=30)


@query("retention_hours", ev_sql("""
SELECT event_id, ts AS created_at FROM ev WHERE NOT ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR"""))
def retention_hours(spark, sf):
    ev = events(spark, sf).select("event_id", F.col("ts").alias("created_at"))
    return T.retention_keep(ev, datetime(2024, 1, 30, 12), hours=1)


def _report(spark, sf):
    tables = {
        "events": table(spark, sf, "events").withColumnRenamed("ts", "timestamp"),
        "orders": table(spark, sf, "orders").withColumnRenamed("o_orderdate", "created_date"),
        "lineitem": table(spark, sf, "lineitem"),
        "nation": table(spark, sf, "nation"),
        "schema_migrations": table(spark, sf, "orders").withColumnRenamed("o_orderdate", "created_at"),
        "future": table(spark, sf, "events").withColumn("created_at", F.col("ts") + F.expr("INTERVAL 365 DAYS")),
    }
    return T.retention_report(tables, {"events": 30, "orders": 365}, AS_OF, time_columns={"lineitem": "l_shipdate"})


REPORT = """
SELECT 'events' AS table_name, count(*) FILTER (ts < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY) AS rows_deleted,
       TIMESTAMP '2024-02-15' AS cleanup_time, CAST(30 AS INTEGER) AS retention_days FROM events
UNION ALL SELECT 'orders', count(*) FILTER (o_orderdate < TIMESTAMP '2024-02-15' - INTERVAL 365 DAY), TIMESTAMP '2024-02-15', 365 FROM orders
UNION ALL SELECT 'lineitem', count(*) FILTER (l_shipdate < TIMESTAMP '2024-02-15' - INTERVAL 90 DAY), TIMESTAMP '2024-02-15', 90 FROM lineitem
UNION ALL SELECT 'future', 0, TIMESTAMP '2024-02-15', 90"""


@query("retention_report", REPORT)
def retention_report(spark, sf):
    return _report(spark, sf)


@query("retention_log", f"SELECT * FROM ({REPORT}) WHERE rows_deleted > 0")
def retention_log(spark, sf):
    path = scratch_path(spark, "cleanup-log")
    T.append_log(_report(spark, sf), path)
    return spark.read.parquet(path)


CLEANED = """SELECT '{0}' AS table_name, count(*) FILTER (ts < TIMESTAMP '2024-02-15 12:00:00' - INTERVAL {1} DAY) AS rows_deleted,
  TIMESTAMP '2024-02-15 12:00:00' AS cleanup_time, CAST({1} AS INTEGER) AS retention_days,
  count(*) FILTER (ts >= TIMESTAMP '2024-02-15 12:00:00' - INTERVAL {1} DAY) AS rows_left, CAST(0 AS BIGINT) AS copies_left FROM events WHERE {2}"""


@query("cleanup_job", " UNION ALL ".join(CLEANED.format(*x) for x in (("events", 30, "true"), ("errors", 20, "event_type = 'error'"))))
def cleanup_job(spark, sf):
    base, ev = scratch_path(spark, "cleanup"), events(spark, sf)
    write_events(ev, f"{base}/events", "ts")
    write_events(ev.where("event_type = 'error'"), f"{base}/errors", "ts")
    tables = [K.StoredTable("events", f"{base}/events", 30, "ts"), K.StoredTable("errors", f"{base}/errors", 20, "ts")]
    done = K.cleanup_job(spark, tables, datetime(2024, 2, 15, 12), f"{base}/journal", f"{base}/log")
    left = None
    for t in tables:
        n = spark.read.parquet(t.path).agg(F.count(F.lit(1)).alias("rows_left")).withColumn("table_name", F.lit(t.name))
        left = n if left is None else left.unionByName(n)
    copies = len(Files(spark).names(f"{base}/journal"))
    return done.join(left, "table_name").withColumn("copies_left", F.lit(copies).cast("long"))


POLICY = """targets AS (SELECT c_custkey, 'region' || CAST(n_regionkey AS VARCHAR) AS kind, n_name AS subject
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
own AS (SELECT 'region' || CAST(n_regionkey AS VARCHAR) AS kind, n_name AS subject, CAST(n_nationkey * 10 AS INTEGER) AS v
  FROM nation WHERE n_name < 'F'),
base AS (SELECT 'region' || CAST(r_regionkey AS VARCHAR) AS kind, CAST(60 + r_regionkey * 20 AS INTEGER) AS v FROM region WHERE r_name <> 'ASIA')"""


@query("policy_resolve", f"""WITH {POLICY}
SELECT t.c_custkey, t.kind, t.subject, greatest(90, coalesce(own.v, base.v, 90)) AS retention_days FROM targets t
LEFT JOIN own ON own.kind = t.kind AND own.subject = t.subject LEFT JOIN base ON base.kind = t.kind""")
def policy_resolve(spark, sf):
    nation = table(spark, sf, "nation")
    kind = F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("kind")
    own = nation.where("n_name < 'F'").select(kind, F.col("n_name").alias("subject"), (F.col("n_nationkey") * 10).alias("retention_days"))
    base = table(spark, sf, "region").where("r_name <> 'ASIA'").select(
        F.concat(F.lit("region"), F.col("r_regionkey").cast("string")).alias("kind"), F.lit("default").alias("subject"),
        (F.col("r_regionkey") * 20 + 60).alias("retention_days"))
    targets = table(spark, sf, "customer").join(small_side(nation), F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("c_custkey", kind, F.col("n_name").alias("subject"))
    return T.resolve_policy(targets, own.unionByName(base), floor=90)


NAMES = """snaps AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN 'note_' || user_id || '.txt'
    WHEN event_id % 13 = 0 THEN 'backup_vm1_' || event_type || '.enc'
    ELSE 'backup_vm' || CAST(event_id % 4 AS VARCHAR) || '_vm_' || event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.enc' END AS name,
    'vm' || CAST(event_id % 4 AS VARCHAR) AS vm_id, 'vm_' || event_type AS config_type, event_id % 11 <> 0 AND event_id % 13 <> 0 AS valid
  FROM ev)"""


def _files(spark, sf):
    n = F.col("event_id")
    name = F.when(n % 11 == 0, F.concat(F.lit("note_"), "user_id", F.lit(".txt"))) \
        .when(n % 13 == 0, F.concat(F.lit("backup_vm1_"), "event_type", F.lit(".enc"))) \
        .otherwise(F.concat(F.lit("backup_vm"), (n % 4).cast("string"), F.lit("_vm_"), "event_type", F.lit("_"),
                            compact_stamp(F.col("ts")), F.lit(".enc")))
    return events(spark, sf).select(F.concat(F.lit("file:/snapshots/"), name).alias("path"),
                                    F.col("ts").alias("modificationTime"), (n * 10).alias("length"))


@query("snapshot_inventory", ev_sql("""
SELECT name AS backup_id, vm_id, config_type, strftime(ts, '%Y%m%d_%H%M%S') AS timestamp, event_id * 10 AS size
FROM snaps WHERE valid AND vm_id = 'vm1' ORDER BY timestamp DESC, backup_id""", NAMES))
def snapshot_inventory(spark, sf):
    return S.snapshot_inventory(_files(spark, sf), vm_id="vm1")


@query("snapshot_expiry", ev_sql("""
SELECT 'strict' AS policy, name AS backup_id, ts AS modified FROM snaps WHERE valid AND ts < TIMESTAMP '2024-04-20' - INTERVAL 90 DAY
UNION ALL SELECT 'whole days', name, ts FROM snaps
WHERE valid AND floor((epoch_us(TIMESTAMP '2024-02-20') - epoch_us(ts)) / 1e6 / 86400) > 30""", NAMES))
def snapshot_expiry(spark, sf):
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    files = _files(spark, sf)
    pick = lambda df, name: df.select(F.lit(name).alias("policy"), "backup_id", F.col("modificationTime").alias("modified"))
    # 30 days asked for, but the floor is 90
    strict = pick(S.expired_snapshots(files, at("2024-04-20"), 30), "strict")
    return strict.unionByName(pick(S.expired_snapshots(files, at("2024-02-20"), 30, whole_days=True), "whole days"))


def _hash_sql(columns: list[str], source: str, by: str, tail: str = "") -> str:
    pairs = ", ".join(f"'{c}': CAST({c} AS VARCHAR)" for c in sorted(columns))
    digest = f"sha256(CAST(to_json({{{pairs}}}) AS VARCHAR))"
    sums = " || '-' || ".join(f"CAST(sum(CAST('0x' || substr({digest}, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(3))
    return f"SELECT {by}, count(*) AS n_rows, {sums} AS content_hash FROM {source} {tail} GROUP BY 1"


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("snapshot_write", _hash_sql(CUSTOMER, "customer", "'customer' AS table_name").replace(
    "count(*) AS n_rows", "'20240131_000000' AS stamp, count(*) AS n_rows"))
def snapshot_write(spark, sf):
    return S.write_snapshot(table(spark, sf, "customer"), scratch_path(spark, "snapshots"), "customer", "20240131_000000")


ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
COPY = """copy AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '2-HIGH' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'
  AND NOT (o_orderpriority = '1-URGENT' AND o_orderkey % 100 = 7))"""
HASHES = f"""{COPY}, a AS ({_hash_sql(ORDER, 'orders', 'o_orderpriority')}), b AS ({_hash_sql(ORDER, 'copy', 'o_orderpriority')})"""


def _copy(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").where((p != "5-LOW") & ~((p == "1-URGENT") & (F.col("o_orderkey") % 100 == 7))) \
        .withColumn("o_orderstatus", F.when(p == "2-HIGH", "X").otherwise(F.col("o_orderstatus")))


@query("reconcile_tables", f"""WITH {HASHES}
SELECT o_orderpriority, coalesce(a.n_rows, 0) AS source_rows, coalesce(b.n_rows, 0) AS copy_rows, a.content_hash AS source_hash,
       b.content_hash AS copy_hash, coalesce(a.content_hash = b.content_hash AND a.n_rows = b.n_rows, FALSE) AS is_synced
FROM a FULL JOIN b USING (o_orderpriority)""")
def reconcile_tables(spark, sf):
    return C.reconcile(table(spark, sf, "orders"), _copy(spark, sf), ["o_orderpriority"])


@query("reconcile_ranges", """
SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 3 THEN 'missing' WHEN o_orderkey % 1000 = 4 THEN 'changed' ELSE 'extra' END AS status,
       CAST(CASE WHEN o_orderkey < 0 THEN 0 ELSE 1 END AS BIGINT) AS source_rows,
       CAST(CASE WHEN o_orderkey % 1000 = 3 THEN 0 ELSE 1 END AS BIGINT) AS copy_rows
FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 IN (3, 4) UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderkey % 1000 = 7)""")
def reconcile_ranges(spark, sf):
    orders, k = table(spark, sf, "orders"), F.col("o_orderkey")
    copy = orders.where(k % 1000 != 3).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 1000 == 4, 0.01).otherwise(0)) \
        .unionByName(orders.where(k % 1000 == 7).withColumn("o_orderkey", -k))
    return V.reconcile_ranges(orders, copy, "o_orderkey", fan=64, leaf_rows=100)


@query("verify_all", f"""WITH {HASHES}
SELECT 'changed copy' AS what, bool_and(coalesce(a.content_hash = b.content_hash, FALSE)) AS all_synced FROM a FULL JOIN b USING (o_orderpriority)
UNION ALL SELECT 'same table', TRUE UNION ALL SELECT 'no targets', TRUE""")
def verify_all(spark, sf):
    orders = table(spark, sf, "orders")
    status = C.reconcile(orders, _copy(spark, sf), ["o_orderpriority"])
    name = lambda df, what: C.verify_all(df).select(F.lit(what).alias("what"), "all_synced")
    same = C.reconcile(orders, orders.select("*"), ["o_orderpriority"])
    return name(status, "changed copy").unionByName(name(same, "same table")).unionByName(name(status.where("false"), "no targets"))


@query("manifest_verify", f"""WITH {HASHES}
SELECT o_orderpriority, a.content_hash AS expected_hash, b.content_hash AS actual_hash FROM a LEFT JOIN b USING (o_orderpriority)
WHERE a.content_hash IS DISTINCT FROM b.content_hash""")
def manifest_verify(spark, sf):
    by = ["o_orderpriority"]
    return C.manifest_mismatches(C.content_hash(table(spark, sf, "orders"), by), C.content_hash(_copy(spark, sf), by), by)


@query("canonical_json", """
SELECT o_orderkey, CAST(to_json({'o_custkey': CAST(o_custkey AS VARCHAR), 'o_orderkey': CAST(o_orderkey AS VARCHAR),
  'o_orderstatus': CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END}) AS VARCHAR) AS doc FROM orders""")
def canonical_json(spark, sf):
    df = table(spark, sf, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")))
    return df.select("o_orderkey", C.canonical_json(["o_orderstatus", "o_orderkey", "o_custkey"]).alias("doc"))


@query("status_diff", ev_sql("""
SELECT coalesce(a.name, b.name) AS name, coalesce(a.status, 'N/A') AS before_status, coalesce(b.status, 'N/A') AS after_status
FROM a FULL JOIN b ON a.name = b.name WHERE coalesce(a.status, 'N/A') <> coalesce(b.status, 'N/A') ORDER BY 1""",
    """a AS (SELECT user_id AS name, CASE arg_max(event_id, event_id) % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'WARN' END AS status
       FROM ev WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'view' GROUP BY 1)""",
    """b AS (SELECT user_id AS name, CASE arg_max(event_id, event_id) % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'WARN' END AS status
       FROM ev WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1)"""))
def status_diff(spark, sf):
    n = F.col("event_id") % 3
    tests = events(spark, sf).select("ts", "event_type", "event_id", F.col("user_id").alias("name"),
                                     F.when(n == 0, "PASS").when(n == 1, "FAIL").otherwise("WARN").alias("status"))
    return C.status_diff(tests.where("ts < timestamp_ntz'2024-01-15' AND event_type <> 'view'"),
                         tests.where("ts >= timestamp_ntz'2024-01-29'"), order="event_id")


@query("audit_rollup", ev_sql("""
SELECT user_id, status, count(*) AS operations, round(avg(secs), 3) AS avg_seconds, round(max(secs), 3) AS max_seconds FROM (
  SELECT user_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         epoch(date_trunc('second', ts + to_seconds(CAST(event_id % 50 AS INTEGER)))) - epoch(date_trunc('second', ts)) AS secs FROM ev)
GROUP BY 1, 2"""))
def audit_rollup(spark, sf):
    return A.audit_rollup(parse_audit(_audit_lines(events(spark, sf))))
