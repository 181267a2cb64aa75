"""Masking, personal data, secrets, mappings and the way back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from huntlake.functions import masking as M
from huntlake.functions import pii as D
from huntlake.functions.parse import parse_audit
from huntlake.operators import privacy as P
from huntlake.session import scratch_path
from huntlake.sources import mapping_store as S
from huntlake.sources.audit_store import deanonymization_store, deanonymize_logged, operations_store
from huntlake.suite.base import KEY, ORACLES, SALT, ev_sql, events, query, table
from huntlake.suite.ingest import _audit_lines


def _h(expr: str) -> str:
    return f"sha256(({expr}) || '{SALT}')"


@query("mask_hash", ev_sql(f"SELECT event_id, {_h('user_id')} AS masked, substring({_h('user_id')}, 1, 12) AS short FROM ev"))
def mask_hash(spark, sf):
    u = F.col("user_id")
    return events(spark, sf).select("event_id", M.mask_hash(u, SALT).alias("masked"), M.mask_hash(u, SALT, 12).alias("short"))


@query("mask_ip", ev_sql(f"""
SELECT event_id, {_h('source_ip')} AS masked,
       CASE WHEN event_id % 9 = 0 THEN {_h("'fe80::' || user_id")}
            ELSE split_part(source_ip, '.', 1) || '.' || split_part(source_ip, '.', 2) || '.' ||
                 {_h("split_part(source_ip, '.', 3) || '.' || split_part(source_ip, '.', 4)")} END AS prefix FROM ev"""))
def mask_ip(spark, sf):
    mixed = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("fe80::"), "user_id")).otherwise(F.col("source_ip"))
    return events(spark, sf).select("event_id", M.mask_ip(F.col("source_ip"), SALT).alias("masked"),
                                    M.mask_ip(mixed, SALT, keep_prefix=True).alias("prefix"))


@query("mask_user", ev_sql(f"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'user_' || {_h('user_id')} END AS masked FROM ev"""))
def mask_user(spark, sf):
    user = F.when(F.col("event_id") % 7 != 0, F.col("user_id"))
    return events(spark, sf).select("event_id", M.mask_user(user, SALT).alias("masked"))


@query("mask_email", ev_sql(f"""
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'user_' || {_h('user_id')}
                      ELSE 'email_' || {_h("user_id || '@example.com'")} END AS masked,
       CASE WHEN event_id % 9 = 0 THEN 'user_' || {_h('user_id')} ELSE 'user_' || {_h('user_id')} || '@example.com' END AS domain
FROM ev"""))
def mask_email(spark, sf):
    mail = F.when(F.col("event_id") % 9 == 0, F.col("user_id")).otherwise(F.concat("user_id", F.lit("@example.com")))
    return events(spark, sf).select("event_id", M.mask_email(mail, SALT).alias("masked"),
                                    M.mask_email(mail, SALT, keep_domain=True).alias("domain"))


@query("mask_path", ev_sql(rf"""
SELECT event_id,
       'C:\Users\user_' || {_h('user_id')} || '\' || split_part(file_path, '\', 4) AS masked,
       '/home/user_' || {_h('user_id')} || '/docs/file_' || {_h("'my_secret' || CAST(event_id AS VARCHAR) || '.txt'")} AS sensitive,
       '/var/log/' || event_type || '.log' AS plain FROM ev"""))
def mask_path(spark, sf):
    num = F.col("event_id").cast("string")
    home = F.concat(F.lit("/home/"), "user_id", F.lit("/docs/my_secret"), num, F.lit(".txt"))
    plain = F.concat(F.lit("/var/log/"), "event_type", F.lit(".log"))
    return events(spark, sf).select("event_id", M.mask_path(F.col("file_path"), SALT).alias("masked"),
                                    M.mask_path(home, SALT).alias("sensitive"), M.mask_path(plain, SALT).alias("plain"))


FIELDS = {"source_ip": "ip", "destination_ip": "ip", "user_id": "user", "file_path": "path", "absent": "other"}


@query("mask_record", ev_sql(rf"""
SELECT event_id, event_type, {_h('source_ip')} AS source_ip, {_h('destination_ip')} AS destination_ip,
       'user_' || {_h('user_id')} AS user_id, 'C:\Users\user_' || {_h('user_id')} || '\' || split_part(file_path, '\', 4) AS file_path,
       process_name, TRUE AS anonymized, 'source_ip,destination_ip,user_id,file_path' AS pii_fields FROM ev"""))
def mask_record(spark, sf):
    df = M.mask_record(events(spark, sf), FIELDS, SALT)
    return df.select("event_id", "event_type", "source_ip", "destination_ip", "user_id", "file_path", "process_name",
                     F.col("metadata.anonymized").alias("anonymized"), F.array_join("metadata.pii_fields", ",").alias("pii_fields"))


# The expected kinds in the order of detection, candidate and full match, for the SQL alone.
SQL_KINDS = {
    "ssn": (r"[0-9]+(?:-[0-9]+)+", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    "credit_card": (r"[0-9](?:[ -]?[0-9]){12,}", r"^[0-9](?:[ -]?[0-9]){12,15}$"),
    "ip_address": (
        r"[0-9]+(?:\.[0-9]+){3,}",
        r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$",
    ),
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
              r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"),
    "phone": (r"\+?[0-9]{0,4}[ .-]?\(?[0-9]{1,4}\)?[ .-][0-9]{1,4}[ .-][0-9]{1,8}",
              r"^(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}$"),
}


def _digits(h: str) -> str:
    return f"regexp_replace({h}, '[ -]', '', 'g')"


LUHN = """list_sum(list_transform(range(1, length({d}) + 1), lambda i:
  CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS INTEGER)
       ELSE CASE WHEN CAST(substr({d}, i, 1) AS INTEGER) * 2 > 9 THEN CAST(substr({d}, i, 1) AS INTEGER) * 2 - 9
                 ELSE CAST(substr({d}, i, 1) AS INTEGER) * 2 END END)) % 10 = 0""".format(d=_digits("h"))


def _pii_ctes(source: str, id_col: str, text: str) -> list[str]:
    """The detection order of the library as a chain of CTEs."""
    ctes, prev = [f"p0 AS (SELECT {id_col} AS id, {text} AS rest FROM {source})"], "p0"
    for i, (kind, (loose, full)) in enumerate(SQL_KINDS.items(), 1):
        test = f"regexp_matches(h, '{full}')" + (f" AND {LUHN}" if kind == "credit_card" else "")
        ctes.append(f"""p{i}h AS (SELECT *, list_filter(list_transform(regexp_extract_all(rest, '{loose}'), lambda x: trim(x)),
          lambda h: {test}) AS h_{kind} FROM {prev})""")
        ctes.append(f"""p{i} AS (SELECT * REPLACE (list_reduce(h_{kind}, lambda acc, h: replace(acc, h, ' '), rest) AS rest) FROM p{i}h)""")
        prev = f"p{i}"
    ctes.append("hits AS (" + " UNION ALL ".join(
        f"SELECT id, '{k}' AS pii_type, CAST(len(h_{k}) AS BIGINT) AS n FROM {prev} WHERE len(h_{k}) > 0" for k in SQL_KINDS) + ")")
    return ctes


def _pii_sql(source: str, id_col: str, text: str, body: str) -> str:
    return "WITH " + ",\n".join(_pii_ctes(source, id_col, text)) + "\n" + body


@query("pii_scan", _pii_sql("documents", "doc_id", "text", "SELECT id AS doc_id, pii_type, n FROM hits"))
def pii_scan(spark, sf):
    return D.pii_scan(table(spark, sf, "documents"), "doc_id", "text")


@query("pii_scan_pages", _pii_sql("pages", "page_id", "html", "SELECT id AS page_id, pii_type, n FROM hits"))
def pii_scan_pages(spark, sf):
    return D.pii_scan(table(spark, sf, "pages"), "page_id", "html")


@query("pii_summary", _pii_sql("documents", "doc_id", "text", """
SELECT CASE WHEN pii_type IN ('email', 'phone') THEN 'contact' WHEN pii_type = 'ip_address' THEN 'network' ELSE 'other' END AS category,
       pii_type, count(*) AS records, CAST(sum(n) AS BIGINT) AS found FROM hits GROUP BY 1, 2"""))
def pii_summary(spark, sf):
    return D.pii_summary(D.pii_scan(table(spark, sf, "documents"), "doc_id", "text"), "doc_id")


@query("pii_columns", ev_sql("""
SELECT 'source_ip' AS column_name, count(source_ip) AS n_values FROM ev UNION ALL
SELECT 'destination_ip', count(destination_ip) FROM ev UNION ALL SELECT 'user_id', count(user_id) FROM ev"""))
def pii_columns(spark, sf):
    ev = events(spark, sf)
    one = ev.agg(*[F.count(c).alias(c) for c in D.pii_columns(ev)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for c in one.columns]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


PROFILED = ("source_ip", "user_id", "contact")


@query("pii_profile", ev_sql(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{k}' AS pii_type, count({c}) AS n_values,
        count(*) FILTER (regexp_matches({c}, '{full}')) AS n_match,
        count({c}) >= 20 AND count(*) FILTER (regexp_matches({c}, '{full}')) >= 0.8 * count({c}) AS is_pii FROM prof"""
    for c in PROFILED for k, (_, full) in SQL_KINDS.items()),
    """prof AS (SELECT source_ip, user_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'n/a'
       ELSE user_id || '@example.com' END AS contact FROM ev)"""))
def pii_profile(spark, sf):
    kind = F.col("event_id") % 6
    contact = F.when(kind == 0, None).when(kind == 1, "n/a").otherwise(F.concat("user_id", F.lit("@example.com")))
    return D.pii_profile(events(spark, sf).withColumn("contact", contact), PROFILED)


def _rule_sql(rule: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{rule}' AS rule, CAST(len(v) AS BIGINT) AS n, substring(sha256(v[1]), 1, 12) AS fingerprint
      FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS v FROM documents) WHERE len(v) > 0"""


SECRETS = " UNION ALL ".join(_rule_sql(r, p) for r, p in D.SECRET_RULES.items())


@query("secret_scan", SECRETS)
def secret_scan(spark, sf):
    return D.secret_scan(table(spark, sf, "documents"), "doc_id", "text")


@query("secret_report", f"""
SELECT count(*) > 0 AS has_secrets, CAST(coalesce(sum(n), 0) AS BIGINT) AS secrets_found,
       TIMESTAMP '2024-01-31' AS scan_timestamp FROM ({SECRETS})""")
def secret_report(spark, sf):
    out = D.secret_report(table(spark, sf, "documents"), "doc_id", "text", "2024-01-31")
    return out.withColumn("scan_timestamp", F.col("scan_timestamp").cast("timestamp_ntz"))


def _values(ev):
    pair = lambda c, t: F.struct(F.col(c).alias("original"), F.lit(t).alias("field_type"))
    return ev.select(F.explode(F.array(pair("user_id", "user"), pair("source_ip", "ip"))).alias("v")).select("v.*")


VALUES = f"""vals AS (
  SELECT DISTINCT user_id AS original, 'user' AS field_type, 'user_' || {_h('user_id')} AS anonymized_value FROM ev
  UNION ALL SELECT DISTINCT source_ip, 'ip', {_h('source_ip')} FROM ev)"""


@query("mapping_new", ev_sql(f"""
SELECT anonymized_value, field_type, TRUE AS encrypted, TIMESTAMP '2024-02-01' AS created_at FROM vals
WHERE NOT (field_type = 'user' AND original IN (SELECT 'user' || CAST(s_suppkey AS VARCHAR) FROM supplier))""", VALUES))
def mapping_new(spark, sf):
    known = table(spark, sf, "supplier").select(
        M.mask_user(F.concat(F.lit("user"), F.col("s_suppkey").cast("string")), SALT).alias("anonymized_value"),
        F.lit("user").alias("field_type"))
    fresh = P.new_mappings(_values(events(spark, sf)), known, SALT, KEY, "2024-02-01")
    return fresh.select("anonymized_value", "field_type", "encrypted", "created_at")


@query("mapping_store", ev_sql("""
SELECT v.anonymized_value, v.field_type, v.original, CASE WHEN e.original IS NULL THEN DATE '2024-02-02' ELSE DATE '2024-02-01' END AS created,
       count(e.original) OVER () AS added_first, count(*) OVER () - count(e.original) OVER () AS added_second, CAST(0 AS BIGINT) AS added_third
FROM vals v LEFT JOIN (SELECT DISTINCT field_type, original FROM vals_even) e ON e.field_type = v.field_type AND e.original = v.original""",
    VALUES, VALUES.replace("vals AS", "vals_even AS").replace("FROM ev", "FROM ev WHERE event_id % 2 = 0")))
def mapping_store(spark, sf):
    """Half of the events, then all, then all again into one store."""
    name = f"mappings_{uuid.uuid4().hex}"
    ev, store = events(spark, sf), S.MappingStore(spark, name, scratch_path(spark, "mappings"), buckets=16).create()
    added = [store.add(_values(part), SALT, KEY, day).first()["added"] for part, day in (
        (ev.where("event_id % 2 = 0"), "2024-02-01"), (ev, "2024-02-02"), (ev, "2024-02-03"))]
    return store.read().select("anonymized_value", "field_type", P.decrypt(F.col("original_value"), KEY).alias("original"),
                               F.col("created_at").cast("date").alias("created"),
                               *[F.lit(n).cast("long").alias(f"added_{w}") for n, w in zip(added, ("first", "second", "third"))])


def _mappings(spark, ev):
    none = ev.where("false").select(F.lit("").alias("anonymized_value"), F.lit("").alias("field_type"))
    return P.new_mappings(_values(ev), none, SALT, KEY, "2024-02-01")


@query("mapping_roundtrip", ev_sql("SELECT anonymized_value, field_type, original FROM vals", VALUES))
def mapping_roundtrip(spark, sf):
    stored = _mappings(spark, events(spark, sf))
    return stored.select("anonymized_value", "field_type", P.decrypt(F.col("original_value"), KEY).alias("original"))


ANSWERS = f"""req AS (
  SELECT event_id AS request_id, 'hunter' || CAST(event_id % 7 AS VARCHAR) AS "user", 'user' AS field_type,
         'user_' || {_h("CASE WHEN event_id % 31 = 0 THEN 'nobody' ELSE user_id END")} AS anonymized_value,
         CASE WHEN event_id % 31 = 0 THEN NULL ELSE user_id END AS original, 'case ' || event_type AS reason, ts AS req_ts
  FROM ev WHERE event_type = 'signup'),
appr AS (
  SELECT 'hunter' || CAST(event_id % 7 AS VARCHAR) AS "user", 'user' AS field_type, 'user_' || {_h('user_id')} AS anonymized_value,
         ts AS appr_ts FROM ev WHERE event_type IN ('view', 'click')),
best AS (
  SELECT r.request_id, max(a.appr_ts) AS appr_ts FROM req r LEFT JOIN appr a
    ON a."user" = r."user" AND a.field_type = r.field_type AND a.anonymized_value = r.anonymized_value AND a.appr_ts <= r.req_ts
  GROUP BY 1),
coded AS (
  SELECT r.*, CASE WHEN r."user" = 'hunter0' THEN 'level3' WHEN r."user" NOT IN ('hunter1', 'hunter2', 'hunter3') THEN 'level1'
         WHEN b.appr_ts IS NULL THEN 'not_approved' WHEN r.req_ts < b.appr_ts + INTERVAL 2 DAY THEN 'approved' ELSE 'expired' END AS reason_code
  FROM req r JOIN best b ON r.request_id = b.request_id)"""


def _case(spark, sf):
    """Requests, approvals and levels."""
    ev = events(spark, sf)
    hunter = F.concat(F.lit("hunter"), (F.col("event_id") % 7).cast("string"))
    wanted = F.when(F.col("event_id") % 31 == 0, "nobody").otherwise(F.col("user_id"))
    requests = ev.where("event_type = 'signup'").select(
        F.col("event_id").alias("request_id"), hunter.alias("user"), F.lit("user").alias("field_type"),
        M.mask_user(wanted, SALT).alias("anonymized_value"), F.concat(F.lit("case "), "event_type").alias("reason"),
        F.col("ts").alias("req_ts"))
    approvals = ev.where("event_type IN ('view', 'click')").select(
        hunter.alias("user"), F.lit("user").alias("field_type"), M.mask_user(F.col("user_id"), SALT).alias("anonymized_value"),
        F.col("ts").alias("appr_ts"))
    # levels as the user directory gives them: 0 is an admin, 1-3 may ask for user names, the rest are unknown
    number = F.substring("user", 7, 2).cast("int")
    people = requests.select("user").distinct()
    levels = people.where(number == 0).select("user", F.lit(None).cast("string").alias("field_type"), F.lit(3).alias("level")) \
        .unionByName(people.where(number.between(1, 3)).select("user", F.lit("user").alias("field_type"), F.lit(2).alias("level"))) \
        .unionByName(people.where(number == 4).select("user", F.lit("ip").alias("field_type"), F.lit(2).alias("level")))
    return requests, _mappings(spark, ev), levels, approvals


def _answers(spark, sf, hot_rows=None):
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    return P.deanonymize(*_case(spark, sf), KEY, timeout_seconds=2 * 86400, **options)


@query("deanonymize", ev_sql("""
SELECT request_id, "user", field_type, reason_code, reason_code IN ('level3', 'approved') AND original IS NOT NULL AS revealed,
       CASE WHEN reason_code IN ('level3', 'approved') THEN original END AS original_value FROM coded""", ANSWERS))
def deanonymize(spark, sf):
    return _answers(spark, sf).select("request_id", "user", "field_type", "reason_code", "revealed", "original_value")


@query("deanonymize_hot", ORACLES["deanonymize"])
def deanonymize_hot(spark, sf):
    return _answers(spark, sf, hot_rows=20).select("request_id", "user", "field_type", "reason_code", "revealed", "original_value")


@query("deanon_audit", ev_sql("""
SELECT "user", req_ts AS timestamp, field_type AS field, reason, reason_code AS approval,
       reason_code IN ('level3', 'approved') AND original IS NOT NULL AS revealed, request_id FROM coded""", ANSWERS))
def deanon_audit(spark, sf):
    return P.deanonymization_audit(_answers(spark, sf))


@query("deanon_store", ev_sql("""
SELECT request_id, "user", reason_code, reason_code IN ('level3', 'approved') AND original IS NOT NULL AS revealed,
       CASE WHEN reason_code IN ('level3', 'approved') THEN original END AS original_value, CAST(req_ts AS DATE) AS logged_at,
       count(*) OVER () AS rows_stored FROM coded""", ANSWERS))
def deanon_store(spark, sf):
    """Every request is answered twice from the same store; the second time nothing more is stored."""
    store = deanonymization_store(spark, scratch_path(spark, "deanonymization"))
    deanonymize_logged(*_case(spark, sf), KEY, store, timeout_seconds=2 * 86400)
    answers = deanonymize_logged(*_case(spark, sf), KEY, store, timeout_seconds=2 * 86400)
    n = store.read().count()
    return answers.select("request_id", "user", "reason_code", "revealed", "original_value", "logged_at", F.lit(n).cast("long").alias("rows_stored"))


@query("audit_store", ev_sql("""
SELECT user_id, source_system AS vm_id, 'ls | grep ' || process_name AS operation, date_trunc('second', ts) AS start,
       CAST(date_trunc('second', ts) AS DATE) AS audit_day, '{"Secret":"kept","k":"' || event_type || '"}' AS extra
FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, source_system, process_name, date_trunc('second', ts) ORDER BY event_id) = 1"""))
def audit_store(spark, sf):
    """Audit lines parsed and stored in two batches that overlap."""
    store = operations_store(spark, scratch_path(spark, "audit-logs"))
    parsed = parse_audit(_audit_lines(events(spark, sf)))
    store.append(parsed.where("event_id % 3 <> 0"))
    store.append(parsed)
    return store.read().select("user_id", "vm_id", "operation", "start", "audit_day", "extra")
