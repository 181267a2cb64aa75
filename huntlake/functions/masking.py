"""Deterministic masking. Everything is a Column expression; NULL stays NULL.

A mask is the hex SHA-256 of the value followed by the salt. ``short`` keeps only the first
hex digits for display; short masks can collide, so joins and stored tables use full length.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.functions.common import MARK, let
from huntlake.schema import METADATA
from huntlake.session import hide

# Name parts treated as sensitive in paths; a list of our own.
SENSITIVE_NAME = r"(?i)(secret|password|passwd|credential|private|confidential)"


def mask_hash(value: Column, salt: str, short: int | None = None) -> Column:
    hide(salt)
    digest = F.sha2(F.concat(value.cast("string"), F.lit(salt)), 256)
    return F.substring(digest, 1, short) if short else digest


def mask_user(value: Column, salt: str, short: int | None = None) -> Column:
    return F.concat(F.lit("user_"), mask_hash(value, salt, short))


def mask_ip(value: Column, salt: str, keep_prefix: bool = False, short: int | None = None) -> Column:
    """Full hash, or the first two octets kept and the host part hashed. Anything that is not
    a dotted quad (IPv6 too) is hashed whole."""
    full = mask_hash(value, salt, short)
    if not keep_prefix:
        return full
    net = F.substring_index(value, ".", 2)
    host = F.substring_index(value, ".", -2)
    dotted = value.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$")
    return F.when(dotted, F.concat(net, F.lit("."), mask_hash(host, salt, short))).otherwise(full)


def mask_email(value: Column, salt: str, keep_domain: bool = False, short: int | None = None) -> Column:
    """``email_<hash>``, or the local part masked like a user with the domain kept. A value
    without @ is masked as a plain identifier."""
    at = F.contains(value, F.lit("@"))
    if keep_domain:
        local = F.regexp_extract(value, r"(?s)^(.*)@", 1)
        hit = F.concat(mask_user(local, salt, short), F.lit("@"), F.substring_index(value, "@", -1))
    else:
        hit = F.concat(F.lit("email_"), mask_hash(value, salt, short))
    return F.when(value.isNotNull(), F.when(at, hit).otherwise(mask_user(value, salt, short)))


def mask_path(value: Column, salt: str, short: int | None = None) -> Column:
    """Structure kept; the component after Users or home is masked, and a sensitive file name
    becomes ``file_<hash>`` without its extension."""
    home = r"(?i)^(.*?[\\/](?:users|home)[\\/])([^\\/]+)(.*)$"

    def leaf(rest: Column) -> Column:
        name = F.substring_index(F.substring_index(rest, "\\", -1), "/", -1)
        folder = F.substring(rest, F.lit(1), F.length(rest) - F.length(name))
        hidden = F.concat(folder, F.lit("file_"), mask_hash(name, salt, short))
        return F.when(name.rlike(SENSITIVE_NAME), hidden).otherwise(rest)

    def rebuild(p: Column) -> Column:
        owned = F.concat(F.get(p, F.lit(0)), mask_user(F.get(p, F.lit(1)), salt, short), leaf(F.get(p, F.lit(2))))
        return F.when(F.size(p) == 3, owned).otherwise(leaf(F.get(p, F.lit(0))))

    clean = F.replace(value, F.lit(MARK), F.lit(" "))
    return let(F.split(F.regexp_replace(clean, home, f"$1{MARK}$2{MARK}$3"), MARK), rebuild)


def mask_kinds(salt: str, *, keep_prefix: bool = False, keep_domain: bool = False,
               short: int | None = None) -> dict[str, Callable[[Column], Column]]:
    """Mask by field type."""
    return {
        "ip": lambda c: mask_ip(c, salt, keep_prefix, short),
        "user": lambda c: mask_user(c, salt, short),
        "email": lambda c: mask_email(c, salt, keep_domain, short),
        "path": lambda c: mask_path(c, salt, short),
        "other": lambda c: mask_hash(c, salt, short),
    }


def mask_field(value: Column, field_type: str, salt: str, **options) -> Column:
    kinds = mask_kinds(salt, **options)
    return kinds.get(field_type, kinds["other"])(value)


def mask_record(df: DataFrame, fields: Mapping[str, str], salt: str, **options) -> DataFrame:
    """Mask the configured fields (name -> field type), leave the rest, mark the record."""
    present = {n: t for n, t in fields.items() if n in df.columns}
    if "metadata" in df.columns:
        flags = F.struct(F.lit(True).alias("anonymized"), F.col("metadata.pii_fields").alias("pii_fields"))
    else:
        flags = F.struct(
            F.lit(True).alias("anonymized"),
            F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in present])).alias("pii_fields"),
        )
    masks = {n: mask_field(F.col(n), t, salt, **options) for n, t in present.items()}
    return df.withColumns({**masks, "metadata": flags.cast(METADATA)})
