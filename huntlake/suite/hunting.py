"""Filters, aggregates, playbooks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntlake.functions.masking import mask_ip
from huntlake.operators import aggregate as A
from huntlake.operators import filters as P
from huntlake.operators import playbooks as B
from huntlake.session import scratch_path
from huntlake.sources import readers as R
from huntlake.sources.event_store import EventStore
from huntlake.sources.sinks import write_events
from huntlake.suite.base import ORACLES, SALT, ev_sql, events, query, table


@query("hunt_like", ev_sql("""
SELECT event_id, ts, user_id, process_name FROM ev
WHERE process_name LIKE '%powershell%' AND ts >= TIMESTAMP '2024-01-01' ORDER BY ts DESC, event_id"""))
def hunt_like(spark, sf):
    ev = events(spark, sf)
    hits = ev.where(P.contains_like(F.col("process_name"), "%powershell%")
                    & (F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")))
    return hits.select("event_id", "ts", "user_id", "process_name").orderBy(F.desc("ts"), "event_id")


@query("hunt_window", ev_sql("""
SELECT event_id, ts, event_type, source_ip, process_name FROM ev
WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-02' ORDER BY ts DESC, event_id LIMIT 1000"""))
def hunt_window(spark, sf):
    day = P.between(events(spark, sf), "ts", "2024-01-01", "2024-01-02")
    return day.select("event_id", "ts", "event_type", "source_ip", "process_name") \
        .orderBy(F.desc("ts"), "event_id").limit(1000)


@query("hunt_sql", ev_sql("""
SELECT event_id, ts, user_id, process_name FROM ev WHERE process_name LIKE '%powershell%' AND ts >= TIMESTAMP '2024-01-10'"""))
def hunt_sql(spark, sf):
    R.register_views(spark, {"security_events": events(spark, sf)})
    return spark.sql(
        "SELECT event_id, ts, user_id, process_name FROM security_events "
        "WHERE process_name LIKE :pattern AND ts >= CAST(:start AS TIMESTAMP_NTZ)",
        args={"pattern": "%powershell%", "start": "2024-01-10"})


@query("store_events", ev_sql("""
SELECT event_id, ts, user_id, event_type FROM ev WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-08'"""))
def store_events(spark, sf):
    path = scratch_path(spark, "events")
    write_events(events(spark, sf).select("event_id", "ts", "user_id", "event_type"), path, "ts")
    stored = P.between(spark.read.parquet(path), "ts", "2024-01-05 12:00:00", "2024-01-08", partition_date="event_date")
    return stored.select("event_id", "ts", "user_id", "event_type")


@query("recent_events", ev_sql("""
SELECT event_id, ts, event_type, user_id FROM ev
WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR ORDER BY ts DESC"""))
def recent_events(spark, sf):
    return P.recent(events(spark, sf), "ts", "2024-01-30 12:00:00", 24).select("event_id", "ts", "event_type", "user_id")


def _store(spark, sf):
    ev = events(spark, sf)
    store = EventStore(spark, scratch_path(spark, "event-store"), ev.schema, "ts")
    store.append(ev.where("event_id % 2 = 0"))
    store.append(ev.where("event_id % 2 = 1"))
    return store


@query("recent_stored", ORACLES["recent_events"])
def recent_stored(spark, sf):
    """From folders per day and files per time, written in two batches."""
    return _store(spark, sf).recent("2024-01-30 12:00:00", 24).select("event_id", "ts", "event_type", "user_id")


@query("filter_eq", ev_sql("SELECT event_id, ts, user_id, value FROM ev WHERE event_type = 'purchase'"))
def filter_eq(spark, sf):
    return events(spark, sf).where(F.col("event_type") == "purchase").select("event_id", "ts", "user_id", "value")


@query("allowlist_semi", ev_sql("""
SELECT event_id, user_id, event_type FROM ev
WHERE user_id IN (SELECT 'user' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)"""))
def allowlist_semi(spark, sf):
    users = table(spark, sf, "customer").select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("name"), (F.col("c_acctbal") > 0).alias("enabled"))
    return P.allowed(events(spark, sf), "user_id", users, "name").select("event_id", "user_id", "event_type")


@query("allowlist_override", ev_sql("""
SELECT event_id, user_id FROM ev WHERE source_system IN ('src_0', 'src_2')"""))
def allowlist_override(spark, sf):
    ev = events(spark, sf)
    return P.allowed(ev, "source_system", ev, "source_system", override=["src_0", "src_2"]).select("event_id", "user_id")


@query("optional_filters", ev_sql("""
SELECT event_id, ts, user_id FROM ev WHERE event_type = 'error' AND process_name = 'bash'"""))
def optional_filters(spark, sf):
    return P.where_all(events(spark, sf), event_type="error", source_system=None, process_name="bash") \
        .select("event_id", "ts", "user_id")


@query("latest_rows", ev_sql("SELECT event_id, ts, user_id, event_type FROM ev ORDER BY ts DESC, event_id DESC LIMIT 5"))
def latest_rows(spark, sf):
    return P.latest(events(spark, sf), "ts", "event_id", 5).select("event_id", "ts", "user_id", "event_type")


@query("latest_per_group", ev_sql("""
SELECT user_id, event_id, ts, event_type FROM ev
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""))
def latest_per_group(spark, sf):
    ev = events(spark, sf).select("user_id", "event_id", "ts", "event_type")
    return P.latest_per_group(ev, "user_id", "ts", "event_id")


@query("union_names", ev_sql("""
SELECT name FROM (SELECT process_name AS name FROM ev UNION SELECT event_type FROM ev) ORDER BY name"""))
def union_names(spark, sf):
    ev = events(spark, sf)
    return P.union_names(ev.select(F.col("process_name").alias("name")), ev.select(F.col("event_type").alias("name")))


@query("hourly_profile", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly_profile(spark, sf):
    return A.hourly_profile(table(spark, sf, "events"))


@query("daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1")
def daily_counts(spark, sf):
    return A.daily_counts(table(spark, sf, "events")).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("resample_hourly", """
WITH c AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
     s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM c), (SELECT max(bucket) FROM c), INTERVAL 1 HOUR)) AS bucket)
SELECT s.bucket AS bucket, coalesce(c.n, 0) AS n FROM s LEFT JOIN c ON s.bucket = c.bucket""")
def resample_hourly(spark, sf):
    return A.resample_hourly(table(spark, sf, "events").where(F.col("event_type") == "error"))


@query("top_sources", ev_sql("""
SELECT source_ip, count(*) AS n FROM ev WHERE source_ip IS NOT NULL GROUP BY 1 ORDER BY n DESC, source_ip LIMIT 10"""))
def top_sources(spark, sf):
    return A.value_counts(events(spark, sf), "source_ip", 10)


@query("top_processes", ev_sql("""
SELECT process_name, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE process_name END AS process_name FROM ev)
GROUP BY 1 ORDER BY n DESC, process_name NULLS LAST LIMIT 10"""))
def top_processes(spark, sf):
    ev = events(spark, sf).withColumn("process_name", F.when(F.col("event_id") % 7 != 0, F.col("process_name")))
    return A.group_counts(ev, "process_name", 10)


@query("events_by_user", ev_sql("SELECT user_id, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, user_id"))
def events_by_user(spark, sf):
    return A.group_counts(events(spark, sf), "user_id")


@query("group_size", ev_sql("""
SELECT source_ip, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE source_ip END AS source_ip FROM ev)
WHERE source_ip IS NOT NULL GROUP BY 1"""))
def group_size(spark, sf):
    ev = events(spark, sf).withColumn("source_ip", F.when(F.col("event_id") % 7 != 0, F.col("source_ip")))
    return A.group_size(ev, "source_ip")


@query("user_profile", ev_sql("""
SELECT user_id, count(event_type) AS n_events, count(DISTINCT destination_ip) AS n_distinct FROM ev GROUP BY 1"""))
def user_profile(spark, sf):
    return A.user_profile(events(spark, sf), distinct="destination_ip")


def _describe(column: str) -> str:
    v = f"CAST({column} AS DOUBLE)"
    return f"""SELECT '{column}' AS column_name, count({column}) AS count, round(avg({v}), 4) AS mean,
       round(stddev_samp({v}), 4) AS std, min({v}) AS min, round(quantile_cont({v}, 0.25), 4) AS q25,
       round(quantile_cont({v}, 0.5), 4) AS q50, round(quantile_cont({v}, 0.75), 4) AS q75, max({v}) AS max FROM events"""


@query("describe_stats", " UNION ALL ".join(_describe(c) for c in ("event_id", "user_id", "value")))
def describe_stats(spark, sf):
    out = A.describe_stats(table(spark, sf, "events"), ["event_id", "user_id", "value"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")})


@query("histogram", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)) + 1, 20) AS BIGINT) AS bin, count(*) AS n
FROM events, b GROUP BY 1""")
def histogram(spark, sf):
    return A.histogram(table(spark, sf, "events"), "value", 20)


CHECKS = """checks AS (
  SELECT process_name AS host, event_type || '/' || source_system AS name,
         CASE count(*) % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' ELSE 'WARN' END AS status
  FROM ev GROUP BY 1, 2)"""


def checks(ev):
    n = F.count(F.lit(1)) % 3
    status = F.when(n == 0, "PASS").when(n == 1, "FAIL").otherwise("WARN")
    return ev.groupBy(F.col("process_name").alias("host"), F.concat_ws("/", "event_type", "source_system").alias("name")) \
        .agg(status.alias("status"))


@query("check_summary", ev_sql("""
SELECT host, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed,
       count(*) FILTER (status = 'WARN') AS warnings, count(*) AS total FROM checks GROUP BY 1""", CHECKS))
def check_summary(spark, sf):
    return A.check_summary(checks(events(spark, sf)), "host")


@query("masked_group", ev_sql(f"""
SELECT sha256(source_ip || '{SALT}') AS source_ip, count(*) AS n FROM ev GROUP BY 1"""))
def masked_group(spark, sf):
    ev = events(spark, sf)
    return A.group_size(ev.withColumn("source_ip", mask_ip(F.col("source_ip"), SALT)), "source_ip")


B.process_hunt("powershell-execution", "execution", "Adversaries run PowerShell", "%powershell%")
B.process_hunt("shell-execution", "execution", "Adversaries run a command shell", "%cmd.exe%")


def _busy_entities(events_df, params):
    counts = B.scope(events_df, params).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    return counts.where("n > 20").select(F.col("user_id").alias("entity"), "ts", F.col("n").cast("string").alias("detail"))


BUSY = B.register(B.Playbook("busy-users", "discovery", "baseline", "Some users are unusually active", _busy_entities))
BROKEN = B.Playbook("no-such-field", "collection", "hypothesis", "Reads a field the table lacks",
                    lambda ev, p: ev.select(F.col("registry_key").alias("entity"), "ts", F.lit("").alias("detail")))


@query("run_playbooks", ev_sql("""
SELECT 'powershell-execution' AS playbook, 'execution' AS tactic, 'hypothesis' AS hunt_type, user_id AS entity, ts,
       process_name AS detail, 'ok' AS status FROM w WHERE process_name LIKE '%powershell%'
UNION ALL SELECT 'shell-execution', 'execution', 'hypothesis', user_id, ts, process_name, 'ok' FROM w WHERE process_name LIKE '%cmd.exe%'
UNION ALL SELECT 'busy-users', 'discovery', 'baseline', user_id, max(ts), CAST(count(*) AS VARCHAR), 'ok' FROM w GROUP BY user_id HAVING count(*) > 20
UNION ALL SELECT 'no-such-field', 'collection', 'hypothesis', NULL, NULL, 'AnalysisException', 'error'""",
    """w AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
      AND event_type IN ('error', 'click'))"""))
def run_playbooks(spark, sf):
    params = B.Params("2024-01-05", "2024-01-20", {"event_type": ["error", "click"], "source_system": None})
    return B.run_playbooks(spark, events(spark, sf), [*B.registered("execution"), BUSY, BROKEN], params)


@query("run_playbooks_stored", ORACLES["run_playbooks"])
def run_playbooks_stored(spark, sf):
    """Over stored events; the range prunes folders in every playbook."""
    params = B.Params("2024-01-05", "2024-01-20", {"event_type": ["error", "click"], "source_system": None}, "event_date")
    return B.run_playbooks(spark, _store(spark, sf).read(), [*B.registered("execution"), BUSY, BROKEN], params)


@query("report_sections", ev_sql("""
SELECT 'summary' AS section, 'title' AS metric, 'PowerShell execution' AS value
UNION ALL SELECT 'summary', 'hypothesis', 'Adversaries run PowerShell'
UNION ALL SELECT 'conclusions', '1', 'Several users run PowerShell'
UNION ALL SELECT 'recommendations', '1', 'Look at the source addresses'
UNION ALL SELECT 'findings', 'count', CAST(count(*) AS VARCHAR) FROM h
UNION ALL SELECT 'findings', 'entities', CAST(count(DISTINCT entity) AS VARCHAR) FROM h
UNION ALL SELECT 'findings', 'first_ts', strftime(min(ts), '%Y-%m-%d %H:%M:%S') FROM h
UNION ALL SELECT 'findings', 'last_ts', strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM h
UNION ALL SELECT 'top_entities', entity, CAST(n AS VARCHAR) FROM (
  SELECT entity, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, entity LIMIT 5)""",
    "h AS (SELECT user_id AS entity, ts FROM ev WHERE process_name LIKE '%powershell%')"))
def report_sections(spark, sf):
    hits = B.registered("execution")[0].build(events(spark, sf), B.Params())
    return B.report_sections(hits, "PowerShell execution", "Adversaries run PowerShell",
                             ["Several users run PowerShell"], ["Look at the source addresses"])
