"""Mappings of masked values, and the audited way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.functions.masking import mask_kinds
from huntlake.plans.ordered import HOT_ROWS, by_key
from huntlake.plans.sizes import small_side
from huntlake.session import hide

APPROVAL_SECONDS = 3600


def encrypt(value: Column, key: str) -> Column:
    """AES-GCM with a random 12-byte nonce in front of the ciphertext."""
    hide(key)
    return F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM"))


def decrypt(value: Column, key: str) -> Column:
    hide(key)
    return F.aes_decrypt(value, F.lit(key), F.lit("GCM")).cast("string")


def mask_by_type(value: Column, field_type: Column, salt: str) -> Column:
    kinds = mask_kinds(salt)
    out = kinds["other"](value)
    for name, fn in kinds.items():
        if name != "other":
            out = F.when(field_type == name, fn(value)).otherwise(out)
    return out


def new_mappings(values: DataFrame, existing: DataFrame, salt: str, key: str, as_of) -> DataFrame:
    """Mapping rows not stored yet, from rows (original, field_type). Values are made distinct
    before encryption, since each encryption of the same value looks different."""
    fresh = (
        values.where(F.col("original").isNotNull()).select("original", "field_type").distinct()
        .withColumn("anonymized_value", mask_by_type(F.col("original"), F.col("field_type"), salt))
        .join(existing.select("anonymized_value", "field_type"), ["anonymized_value", "field_type"], "left_anti")
    )
    return fresh.select(
        encrypt(F.col("original"), key).alias("original_value"), "anonymized_value", "field_type",
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"), F.lit(True).alias("encrypted"),
    )


def deanonymize(requests: DataFrame, mappings: DataFrame, levels: DataFrame, approvals: DataFrame, key: str,
                timeout_seconds: int = APPROVAL_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Answer every request: (…, revealed, original_value, reason_code).

    requests   request_id, user, field_type, anonymized_value, reason, req_ts
    levels     user, field_type (NULL = every field), level; no row means level 1
    approvals  user, field_type, anonymized_value, appr_ts; the newest one before the request counts,
               and its last instant is already expired
    """
    key_cols = ["user", "field_type", "anonymized_value"]
    marks = requests.select(*key_cols, "request_id", "reason", "req_ts",
                            F.col("req_ts").alias("_t"), F.lit(1).alias("_kind")).unionByName(
        approvals.select(*key_cols, F.col("appr_ts").alias("_t"), F.lit(0).alias("_kind")),
        allowMissingColumns=True)
    seen = by_key(
        marks, key_cols, ["_t", "_kind", "request_id"],
        lambda o: o.last_seen("appr_ts", F.when(F.col("_kind") == 0, F.col("_t"))).df.where(F.col("_kind") == 1),
        hot_rows,
    ).drop("_t", "_kind")

    general = small_side(levels.where(F.col("field_type").isNull()).groupBy("user").agg(F.max("level").alias("_any")))
    special = small_side(levels.where(F.col("field_type").isNotNull()).groupBy("user", "field_type")
                         .agg(F.max("level").alias("_field")))
    known = mappings.select("anonymized_value", "field_type", "original_value") \
        .dropDuplicates(["anonymized_value", "field_type"])
    level = F.coalesce(F.greatest("_any", "_field"), F.lit(1))
    live = F.col("req_ts") < F.col("appr_ts") + F.make_dt_interval(secs=F.lit(timeout_seconds))
    code = (
        F.when(level >= 3, "level3").when(level < 2, "level1")
        .when(F.col("appr_ts").isNull(), "not_approved").when(live, "approved").otherwise("expired")
    )
    return (
        seen.join(general, "user", "left").join(special, ["user", "field_type"], "left")
        .withColumn("reason_code", code).drop("_any", "_field")
        .join(known, ["anonymized_value", "field_type"], "left")
        .withColumn("revealed", F.col("reason_code").isin("level3", "approved") & F.col("original_value").isNotNull())
        .withColumn("original_value", F.when(F.col("revealed"), decrypt(F.col("original_value"), key)))
    )


def deanonymization_audit(answers: DataFrame) -> DataFrame:
    """One audit row per request, denied ones too; the revealed value itself is not logged."""
    return answers.select(
        F.col("user"), F.col("req_ts").alias("timestamp"), F.col("field_type").alias("field"), "reason",
        F.col("reason_code").alias("approval"), "revealed", "request_id",
    )
