"""Personal data and secrets in text, fields and columns. Built-in expressions only.

A loose pattern takes the longest candidate and a full-match test decides, so ``1234.1.1.1`` is not
read as an address.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.functions.common import let

# Detection order, candidate pattern, full-match pattern. Groups repeat possessively, or
# the regex engine would recurse once per repetition and end on a long run of digits.
PII_PATTERNS = {
    "ssn": (r"[0-9]+(?:-[0-9]+)++", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
    "credit_card": (r"[0-9](?:[ -]?[0-9]){12,}+", r"^[0-9](?:[ -]?[0-9]){12,15}$"),
    "ip_address": (
        r"[0-9]+(?:\.[0-9]+){3,}+",
        r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$",
    ),
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
              r"^[A-Za-z0-9._%+-]+@(?!\.)(?![A-Za-z0-9.-]*\.\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"),
    "phone": (r"\+?[0-9]{0,4}[ .-]?\(?[0-9]{1,4}\)?[ .-][0-9]{1,4}[ .-][0-9]{1,8}",
              r"^(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}$"),
}

# Category of each kind of personal data.
PII_CATEGORY = {
    "username": "identifier",
    "user_id": "identifier",
    "account": "identifier",
    "employee_id": "identifier",
    "email": "contact",
    "phone": "contact",
    "address": "contact",
    "ip_address": "network",
    "mac_address": "network",
    "hostname": "network",
    "file_path": "file",
    "file_name": "file",
    "credit_card": "other",
    "ssn": "other",
}

# Field names that hold personal data by default.
PII_FIELD_NAMES = ("username", "user_id", "email", "ip_address", "source_ip", "destination_ip")

# Secret rules.
SECRET_RULES = {
    "assignment": r"""(?i)(?:api[_-]?key|secret|token|password|passwd)["']?[ \t]*[:=][ \t]*["']?[A-Za-z0-9_./+=-]{8,}""",
    "pem_header": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "aws_key_id": r"AKIA[0-9A-Z]{16}",
}


def is_kind(value: Column, kind: str) -> Column:
    """The whole value is of this kind (card numbers must also pass the check digit)."""
    ok = value.rlike(PII_PATTERNS[kind][1])
    if kind == "credit_card":
        ok = ok & F.call_function("luhn_check", F.regexp_replace(value, "[ -]", ""))
    return ok


def is_pii(value: Column, kinds: Sequence[str] = tuple(PII_PATTERNS)) -> Column:
    plain = "|".join(f"(?:{PII_PATTERNS[k][1]})" for k in kinds if k != "credit_card")
    test = value.rlike(plain) if plain else F.lit(False)
    if "credit_card" in kinds:
        test = test | is_kind(value, "credit_card")
    return F.coalesce(test, F.lit(False))


def _hits(text: Column, kind: str) -> Column:
    # what fails from the start of a token fails from everywhere in it: do not try again
    start = {"email": "(?<![A-Za-z0-9._%+-])", "phone": ""}.get(kind, "(?<![0-9])")
    found = F.regexp_extract_all(text, F.lit(start + PII_PATTERNS[kind][0]), F.lit(0))
    return F.filter(F.transform(found, lambda h: F.trim(h)), lambda h: is_kind(h, kind))


def pii_hits(df: DataFrame, text: str, kinds: Sequence[str] = tuple(PII_PATTERNS)) -> DataFrame:
    """Adds ``hits``: ARRAY<STRUCT<pii_type, found>> of the kinds present. Each value found is taken
    out of the text before the next kind is looked for, so a card number is not counted again as a
    phone number.

    Without an @ there is only numeric data to find. It lies inside runs of digits and separators,
    none shorter than 7 characters, so one pass reduces the text to those runs.
    """
    runs = F.array_join(F.regexp_extract_all(F.col(text), F.lit("[0-9+() .-]{7,}"), F.lit(0)), "\n")
    out = df.withColumn("_rest", F.when(F.contains(F.col(text), F.lit("@")), F.col(text)).otherwise(runs))
    for kind in kinds:
        out = out.withColumn(f"_h_{kind}", _hits(F.col("_rest"), kind))
        left = F.aggregate(f"_h_{kind}", F.col("_rest"), lambda acc, h: F.replace(acc, h, F.lit(" ")))
        out = out.withColumn("_rest", F.when(F.size(f"_h_{kind}") > 0, left).otherwise(F.col("_rest")))
    entries = F.array(*[F.struct(F.lit(k).alias("pii_type"), F.col(f"_h_{k}").alias("found")) for k in kinds])
    return out.withColumn("hits", F.filter(entries, lambda e: F.size(e["found"]) > 0)).drop(
        "_rest", *[f"_h_{k}" for k in kinds])


def pii_scan(df: DataFrame, id_col: str, text: str, kinds: Sequence[str] = tuple(PII_PATTERNS)) -> DataFrame:
    """Rows (id, pii_type, n) for every record with at least one value found."""
    # the outer form keeps the optimizer from evaluating the whole scan a second time as a filter
    hits = pii_hits(df.select(id_col, text), text, kinds).select(id_col, F.explode_outer("hits").alias("h"))
    return hits.where(F.col("h").isNotNull()).select(
        id_col, "h.pii_type", F.size("h.found").cast("long").alias("n")
    )


def pii_summary(hits: DataFrame, id_col: str) -> DataFrame:
    """Records and values per category and kind."""
    category = F.element_at(F.create_map(*[F.lit(x) for kv in PII_CATEGORY.items() for x in kv]), F.col("pii_type"))
    return (
        hits.withColumn("category", category)
        .groupBy("category", "pii_type")
        .agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("found"))
    )


def pii_flag(df: DataFrame, fields: Sequence[str], extra_names: Sequence[str] = PII_FIELD_NAMES) -> DataFrame:
    """Fill ``metadata``: a field is flagged when non-empty and either named as personal data or
    holding a value of a known kind."""
    named = set(extra_names)
    flags = [
        F.when((F.col(f) != "") & (F.lit(f in named) | is_pii(F.col(f))), F.lit(f)) for f in fields
    ]
    meta = F.struct(F.lit(False).alias("anonymized"), F.array_compact(F.array(*flags)).alias("pii_fields"))
    return df.withColumn("metadata", meta)


def pii_columns(df: DataFrame, names: Sequence[str] = PII_FIELD_NAMES) -> list[str]:
    """Columns whose name marks personal data; read from the schema, no data is touched."""
    wanted = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() in wanted]


def pii_profile(df: DataFrame, columns: Sequence[str], threshold: float = 0.8, min_values: int = 20) -> DataFrame:
    """One scan: per column and kind, how many values match in full, and whether that is enough
    to call the column personal data."""
    aggs = []
    for c in columns:
        aggs.append(F.count(c).alias(f"n|{c}"))
        aggs += [F.count_if(is_kind(F.col(c), k)).alias(f"{k}|{c}") for k in PII_PATTERNS]
    one = df.agg(*aggs)
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("pii_type"),
                 F.col(f"n|{c}").alias("n_values"), F.col(f"{k}|{c}").alias("n_match"))
        for c in columns for k in PII_PATTERNS
    ]
    flat = one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    enough = (F.col("n_values") >= min_values) & (F.col("n_match") >= F.col("n_values") * threshold)
    return flat.withColumn("is_pii", enough)


def secret_scan(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (id, rule, n, fingerprint): the first match is shown as a SHA-256 prefix only."""
    found = [
        F.struct(F.lit(rule).alias("rule"),
                 F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("v"))
        for rule, pattern in SECRET_RULES.items()
    ]
    # every rule needs one of these words, which is far cheaper to look for than the rules
    words = ("key", "secret", "token", "passw", "akia")
    def mentions(low: Column) -> Column:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(low, F.lit(word))
        return test

    rows = df.where(let(F.lower(text), mentions)).select(id_col, F.explode(F.array(*found)).alias("f")).where(F.size("f.v") > 0)
    return rows.select(
        id_col, "f.rule", F.size("f.v").cast("long").alias("n"),
        F.substring(F.sha2(F.col("f.v")[0], 256), 1, 12).alias("fingerprint"),
    )


def secret_report(df: DataFrame, id_col: str, text: str, as_of) -> DataFrame:
    """One row: has_secrets, secrets_found, scan_timestamp."""
    return secret_scan(df, id_col, text).agg(
        (F.count(F.lit(1)) > 0).alias("has_secrets"),
        F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("secrets_found"),
    ).withColumn("scan_timestamp", F.lit(as_of))
