"""Record validation and table checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.functions.pii import secret_scan
from huntlake.operators.records import record_errors


class QualityError(Exception):
    """Raised by a gate before anything is written."""


def missing_required(text: Column, required: Sequence[str]) -> Column:
    """Required keys absent from a JSON object; a key holding null counts as present."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in required]).cast("array<string>"), keys)


def rule_errors(text: Column, schema: Mapping) -> Column:
    """Sorted errors of one JSON record, see ``records.record_errors``; an unknown keyword in the schema raises."""
    return record_errors(text, schema)


def validate(df: DataFrame, text: str, schema: Mapping, out: str = "errors") -> DataFrame:
    return df.withColumn(out, rule_errors(F.col(text), schema))


def validate_versioned(df: DataFrame, text: str, version: str, schemas: Mapping[str, Mapping], base: Mapping,
                       out: str = "errors") -> DataFrame:
    """The schema of the row's version, or the base schema when that version has none."""
    errors = rule_errors(F.col(text), base)
    for name, schema in schemas.items():
        errors = F.when(F.col(version) == name, rule_errors(F.col(text), schema)).otherwise(errors)
    return df.withColumn(out, errors)


def gate(df: DataFrame, violation: Column, limit: int = 0) -> DataFrame:
    """Pass the batch through when at most ``limit`` rows violate, else raise. One count, no rows fetched."""
    bad = df.agg(F.count_if(violation).alias("n")).first()["n"]
    if bad > limit:
        raise QualityError(f"{bad} rows violate the gate (allowed: {limit})")
    return df


def secret_gate(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Pass the batch through when no record holds a secret, else raise; the message names rules, not values."""
    found = secret_scan(df, id_col, text).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per rule
    if found:
        raise QualityError("secrets found: " + ", ".join(f"{r.rule} in {r.n} records" for r in sorted(found)))
    return df


def gate_report(df: DataFrame, violation: Column, limit: int = 0, *group: str) -> DataFrame:
    """What the gate would decide, per group."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(violation).alias("violations")) \
        .withColumn("verdict", F.when(F.col("violations") > limit, "block").otherwise("pass"))


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that break UNIQUE, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def null_keys(df: DataFrame, *key: str) -> DataFrame:
    """Rows that break NOT NULL."""
    test = F.lit(False)
    for k in key:
        test = test | F.col(k).isNull()
    return df.where(test)


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, NULLs, share of NULLs, exact distinct values.

    Distinct values are counted from a per-value aggregate over all columns at once.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))
    values = df.select(cells.alias("e")).select("e.*").groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c"))
    missing = F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0))
    return values.groupBy("column_name").agg(
        F.sum("c").alias("n_rows"), missing.alias("n_null"), F.count("v").alias("n_distinct"),
        F.round(missing / F.sum("c"), 6).alias("null_share"),
    )


def policy_check(policy: DataFrame, days: str = "retention_days", expected: int = 90) -> DataFrame:
    """The expected period passes; any other positive period, or none at all, is a warning."""
    d = F.coalesce(F.col(days), F.lit(0))
    return policy.withColumns({
        "result": F.when(d == expected, "pass").otherwise("warn"),
        "reason": F.when(d == expected, "as expected").when(d > 0, "unexpected period").otherwise("not configured"),
    })
