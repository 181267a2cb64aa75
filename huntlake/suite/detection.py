"""Baselines, order inside an entity, sequences, rules, indicators, the model."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntlake.operators import detect as D
from huntlake.suite.base import ORACLES, ev_sql, events, query, table


@query("baseline_zscore", ev_sql("""
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, n, round(m, 6) AS mean, round(s, 6) AS std, round((n - m) / s, 6) AS z FROM (
  SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS s, count(n) OVER w AS c
  FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM ev GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
WHERE c >= 3 AND s > 0 AND abs((n - m) / s) > 3"""))
def baseline_zscore(spark, sf):
    out = D.baseline_zscore(events(spark, sf))
    return out.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), **{c: F.round(c, 6) for c in ("mean", "std", "z")}})


@query("first_seen", ev_sql("""
SELECT user_id, destination_ip, min(ts) AS first_ts, count(*) AS n FROM ev
WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-27'
  AND (user_id, destination_ip) NOT IN (SELECT (user_id, destination_ip) FROM ev
       WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20')
GROUP BY 1, 2"""))
def first_seen(spark, sf):
    return D.first_seen(events(spark, sf), "user_id", "destination_ip", "ts",
                        ("2024-01-01", "2024-01-20"), ("2024-01-20", "2024-01-27"))


@query("behavior_gaps", ev_sql("""
SELECT user_id, event_id, ts, event_type, lag(ts) OVER w AS prev_ts, lag(event_type) OVER w AS prev_type,
       epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6 AS gap_seconds FROM ev
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""").replace("epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6",
                                                                    "(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6"))
def behavior_gaps(spark, sf):
    return D.behavior_gaps(events(spark, sf))


@query("user_sessions", ev_sql("""
SELECT user_id, CAST(no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ev))
GROUP BY 1, 2"""))
def user_sessions(spark, sf):
    return D.user_sessions(events(spark, sf), gap_seconds=6 * 3600)


@query("burst_detect", ev_sql("""
SELECT source_ip, event_id, ts, n_failures FROM (
  SELECT *, count(*) OVER (PARTITION BY source_ip ORDER BY ts RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW) AS n_failures
  FROM ev WHERE event_type = 'error')
WHERE n_failures >= 2"""))
def burst_detect(spark, sf):
    return D.burst_detect(events(spark, sf).where("event_type = 'error'"), maxretry=2)


BANS = [
    """f AS (SELECT source_system, event_id, ts, row_number() OVER (PARTITION BY source_system ORDER BY ts, event_id) AS r
       FROM ev WHERE event_type = 'error')""",
    """p AS (SELECT *, coalesce(ts - lag(ts, 2) OVER (PARTITION BY source_system ORDER BY r) <= INTERVAL 3600 SECOND, FALSE) AS hit FROM f)""",
    """b AS (SELECT source_system, event_id, ts, r, row_number() OVER (PARTITION BY source_system ORDER BY r) AS k FROM p WHERE hit)""",
    """s AS (SELECT b.source_system, b.k, min(f.r) AS restart FROM b JOIN f ON f.source_system = b.source_system
       AND f.ts >= b.ts + INTERVAL 7200 SECOND GROUP BY 1, 2)""",
    """e AS (SELECT s.source_system, s.k, min(q.k) AS nk FROM s JOIN b q ON q.source_system = s.source_system AND q.r >= s.restart + 2
       GROUP BY 1, 2)""",
    """chain AS (SELECT source_system, k FROM b WHERE k = 1 UNION ALL
       SELECT e.source_system, e.nk FROM chain c JOIN e ON e.source_system = c.source_system AND e.k = c.k)""",
]
BANS_SQL = ev_sql("""
SELECT b.source_system, b.event_id, b.ts AS ban_start, b.ts + INTERVAL 7200 SECOND AS ban_end
FROM chain c JOIN b ON b.source_system = c.source_system AND b.k = c.k""", *BANS, recursive=True)
BAN_RULE = {"source": "source_system", "maxretry": 3, "findtime": 3600, "bantime": 7200}


@query("ban_intervals", BANS_SQL)
def ban_intervals(spark, sf):
    return D.ban_intervals(events(spark, sf).where("event_type = 'error'"), **BAN_RULE)


@query("correlate_interval", ev_sql("""
SELECT a.user_id, a.event_id AS a_id, a.ts AS a_ts, arg_min(b.event_id, (b.ts, b.event_id)) AS b_id, min(b.ts) AS b_ts, count(*) AS n_followers
FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY 1, 2, 3"""))
def correlate_interval(spark, sf):
    t = F.col("event_type")
    return D.correlate_interval(events(spark, sf), t == "error", t == "purchase")


@query("correlate_sources", ev_sql("""
SELECT a.user_id, a.event_id AS a_id, a.ts AS a_ts, count(*) AS n_other
FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
  AND a.source_system <> b.source_system
WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY 1, 2, 3"""))
def correlate_sources(spark, sf):
    t = F.col("event_type")
    return D.correlate_sources(events(spark, sf), t == "error", t == "purchase")


# The same answers when keys are cut into slices: every entity with more than HOT rows counts as hot.
HOT = 20


@query("behavior_gaps_hot", ORACLES["behavior_gaps"])
def behavior_gaps_hot(spark, sf):
    return D.behavior_gaps(events(spark, sf), hot_rows=HOT)


@query("user_sessions_hot", ORACLES["user_sessions"])
def user_sessions_hot(spark, sf):
    return D.user_sessions(events(spark, sf), gap_seconds=6 * 3600, hot_rows=HOT)


@query("burst_detect_hot", ORACLES["burst_detect"])
def burst_detect_hot(spark, sf):
    return D.burst_detect(events(spark, sf).where("event_type = 'error'"), maxretry=2, hot_rows=HOT)


@query("ban_intervals_hot", BANS_SQL)
def ban_intervals_hot(spark, sf):
    return D.ban_intervals(events(spark, sf).where("event_type = 'error'"), **BAN_RULE, hot_rows=HOT)


@query("correlate_interval_hot", ORACLES["correlate_interval"])
def correlate_interval_hot(spark, sf):
    t = F.col("event_type")
    return D.correlate_interval(events(spark, sf), t == "error", t == "purchase", hot_rows=HOT)


@query("correlate_sources_hot", ORACLES["correlate_sources"])
def correlate_sources_hot(spark, sf):
    t = F.col("event_type")
    return D.correlate_sources(events(spark, sf), t == "error", t == "purchase", hot_rows=HOT)


@query("attack_map", ev_sql("""
SELECT event_id, user_id, process_name, technique, 'execution' AS tactic FROM ev JOIN (VALUES
  ('T1059.001', '%powershell%'), ('T1059.003', '%cmd.exe%'), ('T1059.004', '%bash%'), ('T1059.006', '%python%')) r(technique, pattern)
  ON process_name LIKE pattern"""))
def attack_map(spark, sf):
    return D.attack_map(events(spark, sf)).select("event_id", "user_id", "process_name", "technique", "tactic")


FEED = """feed AS (
  SELECT '10.0.' || CAST(s_suppkey % 4 AS VARCHAR) || '.' || CAST(s_suppkey % 250 AS VARCHAR) AS ind, 'ip' AS typ, min(s_name) AS threat
  FROM supplier WHERE s_acctbal < 0 GROUP BY 1
  UNION ALL SELECT 'user' || CAST(c_custkey AS VARCHAR), 'user', c_name FROM customer WHERE c_acctbal < 0)"""


def _feed(spark, sf):
    k = F.col("s_suppkey")
    ip = F.concat(F.lit("10.0."), (k % 4).cast("string"), F.lit("."), (k % 250).cast("string"))
    bad = table(spark, sf, "supplier").where("s_acctbal < 0").groupBy(ip.alias("indicator")).agg(F.min("s_name").alias("threat"))
    people = table(spark, sf, "customer").where("c_acctbal < 0").select(
        F.lit("user").alias("indicator_type"), F.concat(F.lit("user"), F.col("c_custkey").cast("string")).alias("indicator"),
        F.col("c_name").alias("threat"))
    return bad.select(F.lit("ip").alias("indicator_type"), "indicator", "threat").unionByName(people)


@query("ioc_match", ev_sql("""
SELECT event_id, ts, 'source_ip' AS field, ind AS indicator, threat FROM ev JOIN feed ON typ = 'ip' AND ind = source_ip
UNION ALL SELECT event_id, ts, 'destination_ip', ind, threat FROM ev JOIN feed ON typ = 'ip' AND ind = destination_ip
UNION ALL SELECT event_id, ts, 'user_id', ind, threat FROM ev JOIN feed ON typ = 'user' AND ind = user_id""", FEED))
def ioc_match(spark, sf):
    hits = D.match_indicators(events(spark, sf), _feed(spark, sf), {"source_ip": "ip", "destination_ip": "ip", "user_id": "user"})
    return hits.select("event_id", "ts", "field", "indicator", "threat")


@query("ioc_flag", ev_sql("""
SELECT event_id, source_ip FROM ev WHERE source_ip IN (SELECT ind FROM feed WHERE typ = 'ip')""", FEED))
def ioc_flag(spark, sf):
    return D.indicator_flag(events(spark, sf), _feed(spark, sf), "source_ip", "ip").select("event_id", "source_ip")


@query("enrich_source", ev_sql("""
SELECT event_id, source_system, r_name AS owner FROM ev
LEFT JOIN (SELECT * FROM region WHERE r_name <> 'AMERICA') ON source_system = 'src_' || CAST(r_regionkey AS VARCHAR)"""))
def enrich_source(spark, sf):
    meta = table(spark, sf, "region").where("r_name <> 'AMERICA'").select(
        F.concat(F.lit("src_"), F.col("r_regionkey").cast("string")).alias("source_system"), F.col("r_name").alias("owner"))
    return D.enrich_source(events(spark, sf), meta).select("event_id", "source_system", "owner")


FEATURES = """SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error,
       count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'view') AS n_view,
       count(*) FILTER (event_type NOT IN ('click', 'error', 'purchase', 'view')) AS n_other, count(*) AS n_total,
       round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM ev GROUP BY 1"""


@query("user_features", ev_sql(FEATURES))
def user_features(spark, sf):
    return D.user_features(events(spark, sf), types=("click", "error", "purchase", "view"))


MODELLED = ("n_click", "n_error", "n_purchase", "n_view", "error_rate")


# with one cluster the centre is the mean, and SQL can say the same
@query("model_anomaly_one", ev_sql(f"""
SELECT user_id, CAST(0 AS INTEGER) AS cluster, round(distance, 6) AS distance FROM d
WHERE distance > (SELECT quantile_cont(distance, 0.95) FROM d)""", f"f AS ({FEATURES})",
    "s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in MODELLED) + " FROM f)",
    "d AS (SELECT user_id, sqrt(" + " + ".join(f"pow(({c} - m_{c}) / s_{c}, 2)" for c in MODELLED) + ") AS distance FROM f, s)"))
def model_anomaly_one(spark, sf):
    found = D.model_anomaly(user_features(spark, sf), "user_id", list(MODELLED), k=1, quantile=0.95)
    return found.withColumn("distance", F.round("distance", 6))


@query("model_anomaly")
def model_anomaly(spark, sf):
    columns = ["n_click", "n_error", "n_purchase", "n_signup", "n_view", "error_rate"]
    return D.model_anomaly(D.user_features(events(spark, sf)), "user_id", columns)
