"""Streaming queries: everything available is processed, then the sink is read back.

In append mode a window is written once the watermark (one hour behind the newest event) has
passed its end, so the SQL keeps to windows closed by then.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from huntlake.operators import normalize as N
from huntlake.session import scratch_path
from huntlake.sources.adapter import security_events
from huntlake.streaming import bans as B
from huntlake.streaming import live as L
from huntlake.streaming import sequences as Q
from huntlake.streaming.enrich import enriched, live_enrich
from huntlake.suite.base import ev_sql, query, table
from huntlake.suite.detection import BAN_RULE, BANS_SQL
from huntlake.suite.ingest import MAPPING

CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM {}) "


def live_events(spark, sf):
    schema = table(spark, sf, "events").schema
    return security_events(L.live_table(spark, sf, schema, glob="events.parquet"))


def _plain(df, *columns):
    """Zoned timestamps back to wall clock, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("stream_ingest", ev_sql("""
SELECT event_id, ts AS timestamp, source_system, event_type, user_id, file_path FROM ev"""))
def stream_ingest(spark, sf):
    df = N.prepare_events(live_events(spark, sf), {"timestamp": "ts", **MAPPING}, keep=["event_id"])
    out = L.run_available(df.drop("extra"), "ingest")
    return out.select("event_id", "timestamp", "source_system", "event_type", "user_id", "file_path")


@query("stream_tumbling", ev_sql(f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS n FROM ev GROUP BY 1, 2, 3 HAVING window_end <= {CLOSED.format('ev')}"""))
def stream_tumbling(spark, sf):
    out = L.run_available(L.tumbling_counts(live_events(spark, sf), "ts", "1 hour", "event_type"), "tumbling")
    return _plain(out, "window_start", "window_end")


@query("stream_sliding", ev_sql(f"""
SELECT s AS window_start, s + INTERVAL 10 MINUTE AS window_end, source_ip, count(*) AS n FROM (
  SELECT source_ip, unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 9 MINUTE,
                                           time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS s
  FROM ev WHERE event_type = 'error')
GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND window_end <= {CLOSED.format("ev WHERE event_type = 'error'")}"""))
def stream_sliding(spark, sf):
    errors = live_events(spark, sf).where("event_type = 'error'")
    return _plain(L.run_available(L.sliding_bursts(errors, maxretry=2), "sliding"), "window_start", "window_end")


@query("stream_sessions", ev_sql(f"""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n_events FROM (
  SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM ev))
GROUP BY user_id, no HAVING session_end <= {CLOSED.format('ev')}"""))
def stream_sessions(spark, sf):
    out = L.run_available(L.live_sessions(live_events(spark, sf), gap="6 hours"), "sessions")
    return _plain(out, "session_start", "session_end")


@query("stream_dedup", "SELECT DISTINCT event_id - event_id % 2 AS key_id FROM events")
def stream_dedup(spark, sf):
    keyed = live_events(spark, sf).select((F.col("event_id") - F.col("event_id") % 2).alias("key_id"), "ts")
    return L.run_available(L.live_dedup(keyed, "key_id"), "dedup").select("key_id")


# Failures and purchases arrive in three files, one micro-batch each. Every third row of the last 50 minutes before a file
# ends comes with the next file, late but within the watermark.
FILE_ENDS = ("2024-01-11", "2024-01-21")
# what the watermark has passed at the end, by whole minutes
PASSED = "(SELECT time_bucket(INTERVAL 1 MINUTE, max(ts) - INTERVAL 1 HOUR) FROM ev WHERE {})"


def _late_events(spark, sf):
    """The events of type error and purchase as a stream of three micro-batches."""
    raw = table(spark, sf, "events").where("event_type IN ('error', 'purchase')")
    ts, path, part = F.col("ts"), scratch_path(spark, "late-events"), F.lit(len(FILE_ENDS))
    for i in reversed(range(len(FILE_ENDS))):
        end = F.lit(FILE_ENDS[i]).cast("timestamp_ntz")
        late = (F.col("event_id") % 3 == 0) & (ts >= end - F.expr("INTERVAL 50 MINUTES"))
        part = F.when((ts < end) & ~late, i).otherwise(part)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(len(FILE_ENDS) + 1):
        raw.where(part == i).repartition(files).write.mode("append").parquet(path)
    return security_events(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).parquet(path))


@query("stream_sequence", ev_sql(f"""
SELECT a.user_id, a.event_id AS a_id, a.ts AS a_ts, arg_min(b.event_id, (b.ts, b.event_id)) AS b_id, min(b.ts) AS b_ts
FROM ev a JOIN ev b ON b.user_id = a.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY 1, 2, 3
HAVING min(b.ts) < {PASSED.format("event_type IN ('error', 'purchase')")}"""))
def stream_sequence(spark, sf):
    t = F.col("event_type")
    found = Q.live_sequence(_late_events(spark, sf), t == "error", t == "purchase")
    return _plain(L.run_available(found, "sequence"), "a_ts", "b_ts")


@query("stream_enrich", ev_sql("""
SELECT event_id, source_system, r_name AS owner FROM ev
LEFT JOIN (SELECT * FROM region WHERE r_name <> 'AMERICA') ON source_system = 'src_' || CAST(r_regionkey AS VARCHAR)"""))
def stream_enrich(spark, sf):
    def meta(session):
        return table(session, sf, "region").where("r_name <> 'AMERICA'").select(
            F.concat(F.lit("src_"), F.col("r_regionkey").cast("string")).alias("source_system"), F.col("r_name").alias("owner"))

    path = scratch_path(spark, "enrich")
    live_enrich(live_events(spark, sf), meta, path).awaitTermination()
    return enriched(spark, path).select("event_id", "source_system", "owner")


@query("stream_bans", f"""SELECT * FROM ({BANS_SQL}) WHERE ban_start < {PASSED.format("event_type = 'error'").replace("FROM ev", "FROM events")}""")
def stream_bans(spark, sf):
    errors = _late_events(spark, sf).where("event_type = 'error'")
    return _plain(L.run_available(B.live_bans(errors, **BAN_RULE), "bans"), "ban_start", "ban_end")
