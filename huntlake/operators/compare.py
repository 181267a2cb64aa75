"""Before/after comparison and reconciliation of copies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_diff(before: DataFrame, after: DataFrame, order: str | None = None) -> DataFrame:
    """Names whose status changed, ``N/A`` where a side lacks the name. Of repeated names the last
    one by ``order`` counts."""
    def side(df: DataFrame, out: str) -> DataFrame:
        value = F.max_by("status", order) if order else F.max("status")
        return df.groupBy("name").agg(value.alias(out))

    both = side(before, "before_status").join(side(after, "after_status"), "name", "full_outer")
    na = F.lit("N/A")
    return (
        both.select("name", F.coalesce("before_status", na).alias("before_status"),
                    F.coalesce("after_status", na).alias("after_status"))
        .where(F.col("before_status") != F.col("after_status"))
        .orderBy("name")
    )


def canonical_json(columns: Sequence[str]) -> Column:
    """Columns as a JSON object with sorted keys; every value as text, NULLs kept."""
    fields = F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)])
    return F.to_json(fields, {"ignoreNullFields": "false"})


def row_digest(text: Column) -> Column:
    """Aggregate: an order-free digest of rows given as text. Three sums, over the rows, of 60 bits each of the row's SHA-256. It combines
    before the shuffle, so a large group costs no more than others, and repeated rows count."""
    digest = F.sha2(text, 256)
    piece = lambda i: F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    return F.concat_ws("-", *[F.sum(piece(i)).cast("decimal(38,0)").cast("string") for i in range(3)])


def content_hash(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and the ``row_digest`` of their columns per group."""
    columns = columns or [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), row_digest(canonical_json(columns)).alias("content_hash"))


def _match(a: DataFrame, b: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Join on ``by`` with NULL equal to NULL."""
    right = b.withColumnsRenamed({c: f"_r_{c}" for c in by})
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = a.withColumn("_left", F.lit(True)).join(right, cond, how)
    return joined.withColumns({c: F.when(F.col("_left"), F.col(c)).otherwise(F.col(f"_r_{c}")) for c in by}).drop(
        "_left", *[f"_r_{c}" for c in by])


def reconcile(source: DataFrame, copy: DataFrame, by: Sequence[str]) -> DataFrame:
    """Source against copy per group. A group absent on one side is not in sync."""
    columns = [c for c in source.columns if c not in by]
    a = content_hash(source, by, columns).withColumnsRenamed({"n_rows": "source_rows", "content_hash": "source_hash"})
    b = content_hash(copy, by, columns).withColumnsRenamed({"n_rows": "copy_rows", "content_hash": "copy_hash"})
    same = (F.col("source_hash") == F.col("copy_hash")) & (F.col("source_rows") == F.col("copy_rows"))
    zero = F.lit(0).cast("long")
    return _match(a, b, by, "full_outer").select(
        *by, F.coalesce("source_rows", zero).alias("source_rows"), F.coalesce("copy_rows", zero).alias("copy_rows"),
        "source_hash", "copy_hash", F.coalesce(same, F.lit(False)).alias("is_synced"),
    )


def manifest_mismatches(manifest: DataFrame, actual: DataFrame, by: Sequence[str]) -> DataFrame:
    """Manifest entries whose content differs from, or is missing in, what was transferred."""
    got = actual.select(*by, F.col("content_hash").alias("actual_hash"))
    return (
        _match(manifest, got, by, "left")
        .where(~F.col("content_hash").eqNullSafe(F.col("actual_hash")))
        .select(*by, F.col("content_hash").alias("expected_hash"), "actual_hash")
    )


def verify_all(status: DataFrame, flag: str = "is_synced") -> DataFrame:
    """One row: everything in sync. No targets means true; an unknown state counts as false."""
    return status.agg(F.coalesce(F.bool_and(F.coalesce(F.col(flag), F.lit(False))), F.lit(True)).alias("all_synced"))
