"""Common schema: mapping, standard values, defaults and quality flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.functions.parse import iso_timestamp
from huntlake.functions.pii import pii_flag
from huntlake.plans.sizes import small_side
from huntlake.schema import EVENT, EVENT_TEXT_FIELDS

# Fields filled when missing.
DEFAULTS = {"source_system": "unknown", "event_type": "unknown"}


def normalize(df: DataFrame, mapping: Mapping[str, str | Column], keep: Sequence[str] = ()) -> DataFrame:
    """Project a source onto the common schema. ``mapping`` gives the source column or expression
    per target field; columns named nowhere go to ``extra`` as text; ``keep`` are carried as they are."""
    unknown = set(mapping) - set(EVENT.names)
    if unknown:
        raise ValueError(f"not in the common schema: {sorted(unknown)}")
    used = {v for v in mapping.values() if isinstance(v, str)}
    kinds = dict(df.dtypes)
    out: list[Column] = [F.col(k) for k in keep]
    for field in EVENT:
        if field.name == "extra":
            continue
        src = mapping.get(field.name)
        if src is None:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        value = F.col(src) if isinstance(src, str) else src
        if field.name == "timestamp" and isinstance(src, str) and kinds[src] == "string":
            value = iso_timestamp(value)
        out.append(value.cast(field.dataType).alias(field.name))
    rest = [c for c in df.columns if c not in used and c not in keep]
    if rest:
        entries = F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in rest])
        out.append(F.map_from_entries(entries).alias("extra"))
    else:
        out.append(F.lit(None).cast(EVENT["extra"].dataType).alias("extra"))
    return df.select(*out)


def standardize(df: DataFrame, columns: Sequence[str], synonyms: DataFrame | None = None) -> DataFrame:
    """Lower-case and trim; then replace known synonyms, rows (field, raw, standard)."""
    out = df.withColumns({c: F.lower(F.trim(F.col(c))) for c in columns})
    if synonyms is None:
        return out
    synonyms = synonyms.dropDuplicates(["field", "raw"])
    for c in columns:
        per_field = small_side(
            synonyms.where(F.col("field") == c).select(F.col("raw").alias("_raw"), F.col("standard").alias("_std"))
        )
        out = (
            out.join(per_field, F.col(c) == F.col("_raw"), "left")
            .withColumn(c, F.coalesce("_std", c)).drop("_raw", "_std")
        )
    return out


def apply_defaults(df: DataFrame, defaults: Mapping[str, str] = DEFAULTS,
                   required: Sequence[str] = ("source_system", "event_type", "source_ip", "user_id"),
                   timestamp: str = "timestamp") -> DataFrame:
    """Fill defaults and record what was wrong in ``quality_flags``. A timestamp is never made up."""
    flags = [F.when(F.col(timestamp).isNull(), F.lit("bad_timestamp"))]
    flags += [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing_{c}")) for c in required]
    out = df.withColumn("quality_flags", F.array_compact(F.array(*flags)))
    return out.withColumns({
        c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()
    })


def prepare_events(df: DataFrame, mapping: Mapping[str, str | Column], keep: Sequence[str] = ()) -> DataFrame:
    """Normalize, flag quality and flag personal data. Works on batch and streaming frames alike."""
    return pii_flag(apply_defaults(normalize(df, mapping, keep)), list(EVENT_TEXT_FIELDS))
