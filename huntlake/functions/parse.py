"""Raw records to fields. Every parser is a Column expression over one text line."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.functions.common import group_of, groups, let

STR_MAP = "map<string,string>"

# Audit line layout, fields joined by " | ". The first of each leading name decides, so
# what follows it need not be tried again from a later one.
AUDIT_LINE = (
    r"^(?>(?:.*? \| )??user_id=)(?>(.*?) \| vm_id=)(?>(.*?) \| operation=)(.*) \| start=([^|]*) \| end=([^|]*)"
    r" \| status=([^| ]*)(?: \| exit_code=(-?[0-9]+))?(?: \| extra=(\{.*\}))?$"
)
# Database log prefix "%t [%p]: [%l-1] user=%u,db=%d,app=%a,client=%h ".
PG_LINE = (
    r"^([0-9-]+ [0-9:]+) ([A-Z]+) \[([0-9]+)\]: \[([0-9]+)-1\] user=([^,]*),db=([^,]*),app=([^,]*),"
    r"(?:client|host)=([^ ]*) ([A-Z]+):  ?(.*)$"
)
SYSLOG_3164 = r"^<([0-9]+)>([A-Z][a-z]{2}) +([0-9]{1,2}) ([0-9:]{8}) ([^ ]+) ([^:\[ ]+)(?:\[([0-9]+)\])?: (.*)$"
SYSLOG_5424 = r"^<([0-9]+)>1 ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) (-|(?:\[(?:[^\]\\]|\\.)*+\])++) ?(.*)$"
# Keys never kept in extras, compared exactly.
REDACTED_KEYS = ("password", "key", "secret")
# a key with its value in text that is no JSON object: name, ":" or "=", then a quoted text, a list, or what goes up to the next separator
_RAW_VALUE = r"""(?<![A-Za-z0-9_])(["']?(?:%s)["']?\s*[:=]\s*)(?:"(?:[^"\\]|\\.)*+"?|'(?:[^'\\]|\\.)*+'?|[^,;&}\s]*+)"""

WIN_EVENT = (
    "System struct<Provider struct<_Name string>, EventID int, TimeCreated struct<_SystemTime string>,"
    " Computer string>, EventData struct<Data array<struct<_Name string, _VALUE string>>>"
)


def _part(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text, with or without a zone, as a UTC wall-clock timestamp; NULL when unreadable."""
    z = F.regexp_replace(F.trim(text), r"(?:Z|\+00:?00)$", "")
    local = F.try_to_timestamp(F.replace(z, F.lit("T"), F.lit(" ")))
    return local.cast("timestamp_ntz")


def compact_stamp(ts: Column) -> Column:
    """YYYYMMDD_HHMMSS."""
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def detect_format(line: Column) -> Column:
    """First match wins: json, winevent, syslog, audit, csv, unknown."""
    text = F.ltrim(line)
    return (
        F.when(text.startswith("{"), "json")
        .when(F.contains(text, F.lit("<Event")), "winevent")
        .when(text.rlike("^<[0-9]+>"), "syslog")
        .when(F.contains(text, F.lit(" | status=")), "audit")
        .when(F.contains(text, F.lit(",")), "csv")
        .otherwise("unknown")
    )


def json_or_raw(text: Column) -> Column:
    """A JSON object as a string map; anything else under the key ``_raw``."""
    def read(t: Column) -> Column:
        obj = F.when(F.ltrim(t).startswith("{"), F.from_json(t, STR_MAP))
        return F.when(t.isNotNull(), F.coalesce(obj, F.create_map(F.lit("_raw"), t)))

    return let(text, read)


def redact_map(extra: Column, keys: Sequence[str] = REDACTED_KEYS) -> Column:
    """The map without the entries of ``keys``. Under ``_raw``, which holds text that could not be read as an object, the values
    of these keys are blanked."""
    pattern = _RAW_VALUE % "|".join(keys)
    kept = F.map_filter(extra, lambda k, _: ~k.isin(list(keys)))
    return F.transform_values(kept, lambda k, v: F.when(k == "_raw", F.regexp_replace(v, pattern, "$1***")).otherwise(v))


def truncate_text(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def first_line(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit("\n"), F.lit(1)))


def extract_fields(df: DataFrame, line: str, mapping: Mapping[str, tuple]) -> DataFrame:
    """Named fields from a text column. A mapping entry is ("json", path) or ("regex", pattern, group)."""
    cols = {}
    for name, (kind, *args) in mapping.items():
        if kind == "json":
            cols[name] = F.get_json_object(F.col(line), args[0])
        elif kind == "regex":
            cols[name] = _part(F.col(line), args[0], args[1])
        else:
            raise ValueError(f"unknown mapping kind {kind!r} for {name!r}")
    return df.withColumns(cols)


def convert_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Convert text columns; values that do not fit become NULL instead of failing the job."""
    def conv(name: str, kind: str) -> Column:
        return iso_timestamp(F.col(name)) if kind == "timestamp" else F.col(name).try_cast(kind)
    return df.withColumns({n: conv(n, k) for n, k in types.items()})


def parse_audit(df: DataFrame, line: str = "line") -> DataFrame:
    """Audit lines. The operation may contain pipes, so the fields around it are anchored."""
    names = ("user_id", "vm_id", "operation", "start", "end", "status", "exit_code", "extra")
    get = {n: group_of(F.col("_p"), len(names), i) for i, n in enumerate(names, 1)}
    return df.withColumn("_p", groups(F.col(line), AUDIT_LINE, len(names))).withColumns({
        **{n: get[n] for n in ("user_id", "vm_id", "operation", "status")},
        "start": iso_timestamp(get["start"]),
        "end": iso_timestamp(get["end"]),
        "exit_code": get["exit_code"].try_cast("int"),
        "extra": redact_map(json_or_raw(get["extra"])),
    }).drop("_p")


def format_audit(user_id: Column, vm_id: Column, operation: Column, start: Column, end: Column,
                 status: Column, exit_code: Column | None = None, extra: Column | None = None) -> Column:
    """The line form read by ``parse_audit``; secrets are dropped from ``extra``."""
    parts = [
        F.concat(F.lit("user_id="), user_id), F.concat(F.lit("vm_id="), vm_id),
        F.concat(F.lit("operation="), operation), F.concat(F.lit("start="), iso_stamp(start)),
        F.concat(F.lit("end="), iso_stamp(end)), F.concat(F.lit("status="), status),
    ]
    if exit_code is not None:
        parts.append(F.concat(F.lit("exit_code="), exit_code.cast("string")))
    if extra is not None:
        kept = redact_map(extra)
        parts.append(F.when(F.size(kept) > 0, F.concat(F.lit("extra="), F.to_json(kept))))
    return F.concat_ws(" | ", *parts)


def parse_pglog(df: DataFrame, line: str = "line") -> DataFrame:
    get = lambda i: group_of(F.col("_p"), 10, i)
    return df.withColumn("_p", groups(F.col(line), PG_LINE, 10)).withColumns({
        "ts": iso_timestamp(get(1)),
        "pid": get(3).try_cast("int"),
        "line_no": get(4).try_cast("int"),
        "user_id": get(5),
        "db": get(6),
        "app": get(7),
        "client": get(8),
        "level": get(9),
        "message": get(10),
    }).drop("_p")


def failed_login(message: Column) -> Column:
    """Messages the database jail counts as failures."""
    return message.rlike(r"authentication failed|could not connect to server")


def parse_syslog(df: DataFrame, line: str = "line", year: int = 1970) -> DataFrame:
    """Both syslog forms. The older one carries no year, so the caller gives it."""
    c = F.col(line)
    new = F.col("_new")
    get = lambda i: group_of(F.col("_p"), 8, i)
    pri = get(1).try_cast("int")
    old_ts = F.try_to_timestamp(
        F.concat_ws(" ", F.lit(str(year)), get(2), get(3), get(4)), F.lit("yyyy MMM d HH:mm:ss"),
    ).cast("timestamp_ntz")
    pick = lambda a, b: F.when(new, get(a)).otherwise(get(b))
    dash = lambda v: F.nullif(v, F.lit("-"))
    df = df.withColumn("_new", c.rlike(r"^<[0-9]+>1 "))
    df = df.withColumn("_p", F.when(new, groups(c, SYSLOG_5424, 8)).otherwise(groups(c, SYSLOG_3164, 8)))
    return df.withColumns({
        "facility": F.floor(pri / 8).cast("int"),
        "severity": (pri % 8).cast("int"),
        "ts": F.when(new, iso_timestamp(get(2))).otherwise(old_ts),
        "host": dash(pick(3, 5)),
        "app": dash(pick(4, 6)),
        "pid": dash(pick(5, 7)),
        "msg_id": F.when(new, dash(get(6))),
        "structured_data": F.when(new, dash(get(7))),
        "message": get(8),
    }).drop("_new", "_p")


def parse_winevent(df: DataFrame, line: str = "line") -> DataFrame:
    """One exported ``<Event>`` element per row."""
    x = F.from_xml(F.col(line), WIN_EVENT)
    data = F.transform(F.col("_x.EventData.Data"), lambda d: F.struct(d["_Name"].alias("k"), d["_VALUE"].alias("v")))
    return df.withColumn("_x", x).withColumns({
        "ts": iso_timestamp(F.col("_x.System.TimeCreated._SystemTime")),
        "provider": F.col("_x.System.Provider._Name"),
        "event_code": F.col("_x.System.EventID"),
        "host": F.col("_x.System.Computer"),
        "data": _last_wins(F.filter(data, lambda d: d["k"].isNotNull())),
    }).drop("_x")


def _last_wins(pairs: Column) -> Column:
    """A map from (k, v) structs; of repeated keys the last one stays."""
    def unique(p: Column) -> Column:
        return F.filter(p, lambda e, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda o: o["k"] == e["k"]))

    return let(pairs, lambda p: F.map_from_entries(unique(p)))


def _kv(line: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(line, ";"), lambda p: F.contains(p, F.lit("="))),
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("k"),
            F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v"),
        ),
    )
    return _last_wins(pairs)


_PARSERS: dict[str, Callable[[Column], Column]] = {"kv": _kv, "json": json_or_raw}


def register_parser(name: str, fn: Callable[[Column], Column]) -> None:
    """Add a format: a function from the line column to a MAP<STRING,STRING> column."""
    _PARSERS[name] = fn


def parse_custom(df: DataFrame, fmt: str, line: str = "line") -> DataFrame:
    if fmt not in _PARSERS:
        raise ValueError(f"no parser registered for {fmt!r}")
    return df.withColumn("fields", _PARSERS[fmt](F.col(line)))


def is_malformed(corrupt: str = "_corrupt", timestamp: str = "timestamp") -> Column:
    return F.col(corrupt).isNotNull() | F.col(timestamp).isNull()


def split_quarantine(df: DataFrame, corrupt: str = "_corrupt", timestamp: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): malformed means unreadable, or no usable timestamp. Nothing is lost."""
    bad = is_malformed(corrupt, timestamp)
    return df.where(~bad).drop(corrupt), df.where(bad)


def snapshot_name(df: DataFrame, path: str = "path") -> DataFrame:
    """Split ``backup_{subject}_{type}_{YYYYMMDD}_{HHMMSS}.enc``; other names are left out."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    inner = F.regexp_extract(name, r"^backup_(.*)\.enc$", 1)
    out = df.withColumn("backup_id", name).withColumn("_p", F.split(inner, "_"))
    n = F.size("_p")
    return (
        out.where((F.col("backup_id").rlike(r"^backup_.*\.enc$")) & (n >= 4))
        .withColumns({
            "vm_id": F.col("_p")[0],
            "config_type": F.array_join(F.slice("_p", F.lit(2), n - 3), "_"),
            "timestamp": F.array_join(F.slice("_p", n - 1, F.lit(2)), "_"),
        })
        .drop("_p")
    )
