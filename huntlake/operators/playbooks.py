"""Parameterized hunts and their reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.operators.detect import baseline_zscore, model_anomaly, user_features
from huntlake.operators.filters import between, contains_like
from huntlake.plans.sizes import local_rows
from huntlake.session import pin, scratch_path

# Tactic names and hunt types.
TACTICS = (
    "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion",
    "credential-access", "discovery", "lateral-movement", "collection", "exfiltration",
    "command-and-control",
)
HUNT_TYPES = ("hypothesis", "baseline", "model")
RESULT = ("entity", "ts", "detail")


@dataclass(frozen=True)
class Params:
    """What a hunter sets before running: a half-open time range and equality filters. ``partition_date`` names the column by
    whose day the events are stored, so that the range prunes folders."""

    start: str | None = None
    end: str | None = None
    filters: dict = field(default_factory=dict)
    partition_date: str | None = None


@dataclass(frozen=True)
class Playbook:
    """``build`` takes (events, params) and returns columns entity, ts, detail."""

    name: str
    tactic: str
    hunt_type: str
    hypothesis: str
    build: Callable[[DataFrame, Params], DataFrame]

    def __post_init__(self):
        if self.tactic not in TACTICS:
            raise ValueError(f"unknown tactic {self.tactic!r}")
        if self.hunt_type not in HUNT_TYPES:
            raise ValueError(f"unknown hunt type {self.hunt_type!r}")


_REGISTRY: dict[str, Playbook] = {}


def register(playbook: Playbook) -> Playbook:
    _REGISTRY[playbook.name] = playbook
    return playbook


def registered(tactic: str | None = None) -> list[Playbook]:
    return [p for p in _REGISTRY.values() if tactic is None or p.tactic == tactic]


def scope(events: DataFrame, params: Params, ts: str = "ts") -> DataFrame:
    """Events inside the playbook's range and filters; both reach the scan."""
    if params.start is not None or params.end is not None:
        events = between(events, ts, params.start or "0001-01-01", params.end or "9999-12-31", params.partition_date)
    for name, value in params.filters.items():
        if value is not None:
            events = events.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return events


def process_hunt(name: str, tactic: str, hypothesis: str, pattern: str) -> Playbook:
    """A hypothesis hunt for processes like ``pattern``."""
    def build(events: DataFrame, params: Params) -> DataFrame:
        hits = scope(events, params).where(contains_like(F.col("process_name"), pattern))
        return hits.select(F.col("user_id").alias("entity"), "ts", F.col("process_name").alias("detail"))

    return register(Playbook(name, tactic, "hypothesis", hypothesis, build))


def baseline_hunt(name: str, tactic: str, hypothesis: str, **options) -> Playbook:
    """A baseline hunt: days on which an entity was far from its own recent days."""
    def build(events: DataFrame, params: Params) -> DataFrame:
        odd = baseline_zscore(scope(events, params), **options)
        return odd.select(F.col("user_id").alias("entity"), F.col("day").cast("timestamp_ntz").alias("ts"),
                          F.concat(F.lit("events="), F.col("n").cast("string")).alias("detail"))

    return register(Playbook(name, tactic, "baseline", hypothesis, build))


def model_hunt(name: str, tactic: str, hypothesis: str, columns: Sequence[str], **options) -> Playbook:
    """A model-assisted hunt: entities far from every group of similar ones."""
    def build(events: DataFrame, params: Params) -> DataFrame:
        inside = scope(events, params)
        odd = model_anomaly(user_features(inside), "user_id", columns, **options)
        last = inside.groupBy("user_id").agg(F.max("ts").alias("ts"))
        return odd.join(last, "user_id").select(
            F.col("user_id").alias("entity"), "ts", F.concat(F.lit("cluster="), F.col("cluster").cast("string")).alias("detail"))

    return register(Playbook(name, tactic, "model", hypothesis, build))


def run_playbooks(spark: SparkSession, events: DataFrame, playbooks: Sequence[Playbook], params: Params) -> DataFrame:
    """All results in one frame: playbook, tactic, hunt_type, entity, ts, detail, status.

    Each playbook is run and written on its own, so one that fails, while planning or while
    running, leaves an error row and the others go on.
    """
    parts = []
    for i, book in enumerate(playbooks):
        label = [F.lit(book.name).alias("playbook"), F.lit(book.tactic).alias("tactic"),
                 F.lit(book.hunt_type).alias("hunt_type")]
        path = scratch_path(spark, f"playbook-{i}")
        try:
            book.build(events, params).select(
                F.col("entity").cast("string").alias("entity"), F.col("ts").cast("timestamp_ntz").alias("ts"),
                F.col("detail").cast("string").alias("detail"),
            ).write.parquet(path)
            part = spark.read.parquet(path).select(*label, *RESULT, F.lit("ok").alias("status"))
        except Exception as exc:  # any failure of one hunt is part of the report
            part = spark.range(1).select(
                *label, F.lit(None).cast("string").alias("entity"), F.lit(None).cast("timestamp_ntz").alias("ts"),
                F.lit(type(exc).__name__).alias("detail"), F.lit("error").alias("status"))
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report_sections(findings: DataFrame, title: str, hypothesis: str, conclusions: Sequence[str] = (),
                    recommendations: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Report data as rows (section, metric, value): counts, span, top entities, and the given text."""
    spark = findings.sparkSession
    stamp = "yyyy-MM-dd HH:mm:ss"
    # one row per entity, kept because both the totals and the ranking read it
    per = pin(findings.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.count("entity").alias("entities"),
                  F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"))
    cell = lambda m, v: F.struct(F.lit("findings").alias("section"), F.lit(m).alias("metric"), v.alias("value"))
    totals = one.select(F.explode(F.array(
        cell("count", F.col("findings").cast("string")), cell("entities", F.col("entities").cast("string")),
        cell("first_ts", F.date_format("first_ts", stamp)), cell("last_ts", F.date_format("last_ts", stamp)),
    )).alias("r")).select("r.*")
    best = (
        per.where(F.col("entity").isNotNull()).orderBy(F.desc("n"), "entity").limit(top)
        .select(F.lit("top_entities").alias("section"), F.col("entity").alias("metric"), F.col("n").cast("string").alias("value"))
    )
    text = [("summary", "title", title), ("summary", "hypothesis", hypothesis)]
    text += [("conclusions", str(i + 1), t) for i, t in enumerate(conclusions)]
    text += [("recommendations", str(i + 1), t) for i, t in enumerate(recommendations)]
    given = local_rows(spark, text, "section string, metric string, value string")
    return given.unionByName(totals).unionByName(best)
