"""Validation, constraints, gates and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntlake.operators import quality as Q
from huntlake.suite.base import ev_sql, events, query, table

STRICT = {
    "properties": {
        "rule": {"type": "string", "minLength": 3, "pattern": "^[a-z_]+$"},
        "severity": {"enum": ["low", "high"]},
        "hits": {"type": "integer", "minimum": 1},
        "hosts": {"type": "array", "items": {"type": "string"}, "maxItems": 2},
        "origin": {"type": "object", "required": ["ip"], "properties": {"ip": {"type": "string"}}},
    },
    "required": ["rule", "severity"],
    "additionalProperties": False,
}
LOOSE = {"properties": {"rule": {"type": ["string", "null"]}, "hits": {"type": "number", "maximum": 100}}, "required": ["hits"]}

RECORDS = """recs AS (
  SELECT event_id, 'v' || CAST(event_id % 3 AS VARCHAR) AS version, CASE event_id % 7
    WHEN 0 THEN '{"rule":"' || event_type || '_rate","severity":"low","hits":' || CAST(event_id AS VARCHAR) || '}'
    WHEN 1 THEN '{"severity":"high"}'
    WHEN 2 THEN '{"rule":"x","severity":"medium","seen_by":"' || user_id || '"}'
    WHEN 3 THEN '{"rule":' || CAST(event_id AS VARCHAR) || ',"severity":"low","hosts":["a",1,"c"]}'
    WHEN 4 THEN '{"rule":null,"severity":"high","hits":2.0}'
    WHEN 5 THEN '{"rule":"Bad Rule","severity":"low","hits":1.5,"origin":{}}'
    ELSE '{"rule" broken' END AS j FROM ev)"""


def _listed(*cases: str) -> str:
    lines = ", ".join(f"CASE WHEN {case} END" for case in cases)
    return f"CASE WHEN NOT json_valid(j) THEN 'type:$' ELSE array_to_string(list_sort(list_filter([{lines}], lambda x: x IS NOT NULL)), ',') END"


RULE, HITS = "json_extract_string(j, '$.rule')", "CAST(json_extract_string(j, '$.hits') AS DOUBLE)"
STRICT_SQL = _listed(
    "json_exists(j, '$.seen_by') THEN 'additional:seen_by'",
    "json_extract_string(j, '$.severity') NOT IN ('low', 'high') THEN 'enum:severity'",
    "NOT json_exists(j, '$.rule') THEN 'required:rule'", "NOT json_exists(j, '$.severity') THEN 'required:severity'",
    "json_exists(j, '$.rule') AND json_type(j, '$.rule') <> 'VARCHAR' THEN 'type:rule'",
    f"json_type(j, '$.rule') = 'VARCHAR' AND length({RULE}) < 3 THEN 'minLength:rule'",
    f"json_type(j, '$.rule') = 'VARCHAR' AND NOT regexp_matches({RULE}, '^[a-z_]+$') THEN 'pattern:rule'",
    f"{HITS} < 1 THEN 'minimum:hits'", f"{HITS} % 1 <> 0 THEN 'type:hits'",
    "json_array_length(j, '$.hosts') > 2 THEN 'maxItems:hosts'", "json_type(j, '$.hosts[1]') <> 'VARCHAR' THEN 'type:hosts[1]'",
    "json_exists(j, '$.origin') AND NOT json_exists(j, '$.origin.ip') THEN 'required:origin.ip'")
LOOSE_SQL = _listed(
    "NOT json_exists(j, '$.hits') THEN 'required:hits'", f"{HITS} > 100 THEN 'maximum:hits'",
    "json_exists(j, '$.rule') AND json_type(j, '$.rule') NOT IN ('VARCHAR', 'NULL') THEN 'type:rule'")


def records(spark, sf):
    kind, num = F.col("event_id") % 7, F.col("event_id").cast("string")
    j = (
        F.when(kind == 0, F.concat(F.lit('{"rule":"'), "event_type", F.lit('_rate","severity":"low","hits":'), num, F.lit("}")))
        .when(kind == 1, F.lit('{"severity":"high"}'))
        .when(kind == 2, F.concat(F.lit('{"rule":"x","severity":"medium","seen_by":"'), "user_id", F.lit('"}')))
        .when(kind == 3, F.concat(F.lit('{"rule":'), num, F.lit(',"severity":"low","hosts":["a",1,"c"]}')))
        .when(kind == 4, F.lit('{"rule":null,"severity":"high","hits":2.0}'))
        .when(kind == 5, F.lit('{"rule":"Bad Rule","severity":"low","hits":1.5,"origin":{}}'))
        .otherwise(F.lit('{"rule" broken'))
    )
    version = F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string"))
    return events(spark, sf).select("event_id", version.alias("version"), j.alias("j"))


@query("dq_required", ev_sql("""
SELECT event_id, concat_ws(',', CASE WHEN NOT json_valid(j) OR NOT json_exists(j, '$.rule') THEN 'rule' END,
                           CASE WHEN NOT json_valid(j) OR NOT json_exists(j, '$.hits') THEN 'hits' END) AS missing FROM recs""", RECORDS))
def dq_required(spark, sf):
    return records(spark, sf).select("event_id", F.array_join(Q.missing_required(F.col("j"), ["rule", "hits"]), ",").alias("missing"))


@query("dq_validate", ev_sql(f"SELECT event_id, {STRICT_SQL} AS errors FROM recs", RECORDS))
def dq_validate(spark, sf):
    return Q.validate(records(spark, sf), "j", STRICT).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("dq_versioned", ev_sql(f"""
SELECT event_id, version, CASE WHEN version = 'v1' THEN {LOOSE_SQL} ELSE {STRICT_SQL} END AS errors FROM recs""", RECORDS))
def dq_versioned(spark, sf):
    out = Q.validate_versioned(records(spark, sf), "j", "version", {"v1": LOOSE}, STRICT)
    return out.select("event_id", "version", F.array_join("errors", ",").alias("errors"))


@query("dq_gate", ev_sql("""
SELECT source_system, count(*) AS n_rows, count(*) FILTER (value > 300) AS violations,
       CASE WHEN count(*) FILTER (value > 300) > 2 THEN 'block' ELSE 'pass' END AS verdict FROM ev GROUP BY 1"""))
def dq_gate(spark, sf):
    ev = Q.gate(events(spark, sf), F.col("value") < 0)  # nothing negative: the batch passes on
    return Q.gate_report(ev, F.col("value") > 300, 2, "source_system")


@query("dq_unique", """
SELECT k, count(*) AS n FROM (SELECT event_id - CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS k FROM events)
GROUP BY 1 HAVING count(*) > 1""")
def dq_unique(spark, sf):
    k = F.col("event_id") - F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)
    return Q.duplicate_keys(table(spark, sf, "events").select(k.alias("k")), "k")


@query("dq_not_null", """
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_type END AS event_type FROM events WHERE event_id % 97 = 0""")
def dq_not_null(spark, sf):
    holes = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 97 != 0, F.col("event_type")).alias("event_type"))
    return Q.null_keys(holes, "event_id", "event_type")


def _profile(column: str) -> str:
    return f"""SELECT '{column}' AS column_name, count(*) AS n_rows, count(*) - count({column}) AS n_null,
       count(DISTINCT {column}) AS n_distinct, round((count(*) - count({column})) / count(*), 6) AS null_share FROM holes"""


@query("dq_profile", ev_sql(" UNION ALL ".join(_profile(c) for c in ("event_id", "user_id", "process_name")),
    """holes AS (SELECT event_id, user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE process_name END AS process_name FROM ev)"""))
def dq_profile(spark, sf):
    holes = events(spark, sf).withColumn("process_name", F.when(F.col("event_id") % 97 != 0, F.col("process_name")))
    return Q.profile(holes, ["event_id", "user_id", "process_name"])


@query("policy_check", """
SELECT c_custkey, d AS retention_days, CASE WHEN d = 90 THEN 'pass' ELSE 'warn' END AS result,
       CASE WHEN d = 90 THEN 'as expected' WHEN d > 0 THEN 'unexpected period' ELSE 'not configured' END AS reason
FROM (SELECT c_custkey, CAST(c_nationkey * 10 AS INTEGER) AS d FROM customer)""")
def policy_check(spark, sf):
    policy = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") * 10).alias("retention_days"))
    return Q.policy_check(policy)
