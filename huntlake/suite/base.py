"""Registry and inputs shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from huntlake.sources.adapter import security_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SALT = "demo-salt"
KEY = "0123456789abcdef0123456789abcdef"

EV = r"""ev AS (
  SELECT event_id, ts, event_type, value,
         'src_' || CAST(event_id % 3 AS VARCHAR) AS source_system,
         '10.0.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS source_ip,
         '10.1.0.' || CAST(event_id % 50 AS VARCHAR) AS destination_ip,
         'user' || CAST(user_id AS VARCHAR) AS user_id,
         CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 5
           WHEN 0 THEN 'powershell.exe' WHEN 1 THEN 'cmd.exe' WHEN 2 THEN 'svchost.exe'
           WHEN 3 THEN 'bash' ELSE 'python' END AS process_name,
         'C:\Users\user' || CAST(user_id AS VARCHAR) || '\f' || json_extract_string(props, '$.k') || '.txt' AS file_path
  FROM events)"""


def ev_sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """SQL over the adapted events, with more CTEs when given."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([EV, *ctes]) + "\n" + body


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security_events(table(spark, sf_dir, "events"))
