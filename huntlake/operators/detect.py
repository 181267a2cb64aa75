"""Behaviour, bursts, bans, sequences, techniques, indicators and the anomaly model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntlake.plans.ordered import HOT_ROWS, Ordered, by_key
from huntlake.plans.quantiles import exact_quantiles
from huntlake.plans.sizes import small_side
from huntlake.session import pin


def _secs(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


# ---- baseline -------------------------------------------------------------------------------

def baseline_zscore(df: DataFrame, key: str = "user_id", ts: str = "ts", days: int = 7, min_days: int = 3,
                    limit: float = 3.0) -> DataFrame:
    """Daily counts far from the entity's preceding active days. Windows run over the daily counts,
    at most one row per entity and day."""
    daily = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("day").rowsBetween(-days, -1)
    return (
        daily.withColumns({"mean": F.avg("n").over(w), "std": F.stddev_samp("n").over(w), "_seen": F.count("n").over(w)})
        .where((F.col("_seen") >= min_days) & (F.col("std") > 0))
        .withColumn("z", (F.col("n") - F.col("mean")) / F.col("std"))
        .where(F.abs("z") > limit).drop("_seen")
    )


def first_seen(df: DataFrame, entity: str, value: str, ts: str, baseline: tuple, recent: tuple,
               partition_date: str | None = None) -> DataFrame:
    """Pairs seen in the recent window and never in the baseline window; both are half-open. Missing
    entities and values are not pairs. One scan and one shuffle; name the date partition column to
    read only the folders of the two windows."""
    def inside(window) -> Column:
        lo, hi = (F.lit(x).cast("timestamp_ntz") for x in window)
        time = (F.col(ts) >= lo) & (F.col(ts) < hi)
        if partition_date:
            time = time & (F.col(partition_date) >= F.to_date(lo)) & (F.col(partition_date) <= F.to_date(hi))
        return time

    rows = df.where((inside(baseline) | inside(recent)) & F.col(entity).isNotNull() & F.col(value).isNotNull())
    seen = rows.groupBy(entity, value).agg(
        F.min(F.when(inside(recent), F.col(ts))).alias("first_ts"), F.count_if(inside(recent)).alias("n"),
        F.count_if(inside(baseline)).alias("_known"))
    return seen.where("_known = 0 and n > 0").drop("_known")


# ---- order inside an entity -----------------------------------------------------------------

def behavior_gaps(df: DataFrame, key: str = "user_id", ts: str = "ts", event_id: str = "event_id",
                  event_type: str = "event_type", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Seconds since the entity's previous event, and that event's type."""
    def step(o: Ordered) -> DataFrame:
        out = o.previous(prev_ts=F.col(ts), prev_type=F.col(event_type)).df
        return out.withColumn("gap_seconds", F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col(ts)) / 1e6)

    return by_key(df.select(key, event_id, ts, event_type), [key], [ts, event_id], step, hot_rows)


def user_sessions(df: DataFrame, key: str = "user_id", ts: str = "ts", event_id: str = "event_id",
                  gap_seconds: int = 1800, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sessions split where the gap exceeds ``gap_seconds``: number, start, end, events."""
    def step(o: Ordered) -> DataFrame:
        o = o.previous(_prev_ts=F.col(ts))
        starts = F.col("_prev_ts").isNull() | (F.col(ts) > F.col("_prev_ts") + _secs(gap_seconds))
        o = o.running_sum("session_no", F.when(starts, 1).otherwise(0).cast("long"))
        return o.df.groupBy(key, "session_no").agg(
            F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count(F.lit(1)).alias("n_events")
        )

    return by_key(df.select(key, event_id, ts), [key], [ts, event_id], step, hot_rows)


def _events_of(df: DataFrame, source: str, ts: str, event_id: str) -> DataFrame:
    """Fixed inner names, so that the caller's column names cannot clash with working columns. A row
    without a time is in no window and is left out."""
    return df.select(F.col(source).alias("_src"), F.col(ts).alias("_ts"), F.col(event_id).alias("_id")).where(F.col("_ts").isNotNull())


def _each(df: DataFrame, copies: str) -> DataFrame:
    """Every row as often as ``copies`` says: events delivered more than once count and are returned each time."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop("_copy", copies)


def burst_detect(df: DataFrame, source: str = "source_ip", ts: str = "ts", event_id: str = "event_id",
                 maxretry: int = 5, findtime: int = 600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Failures with at least ``maxretry`` failures of the same source in the ``findtime`` seconds up
    to and including their instant. Failures without a time are in no window; repeated rows count
    and are returned each.

    The count is a difference of two running totals (at the event, and just before the window), so
    each row is touched a fixed number of times however many failures the window holds.
    """
    back = F.col("_ts") - _secs(findtime)
    at_event = F.max(F.when(F.col("kind") == 1, F.col("c")))
    before_window = F.max(F.when(F.col("kind") == 0, F.col("c")))

    def marks(rows: DataFrame, weight: Column) -> DataFrame:
        both = F.array(
            F.struct(F.col("_ts").alias("t"), F.lit(1).alias("kind"), weight.alias("w")),
            F.struct(back.alias("t"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("w")),
        )
        return rows.withColumn("m", F.explode(both)).select(*[c for c in rows.columns if c != "w"], "m.*")

    def step(o: Ordered) -> DataFrame:
        w = Window.partitionBy("_src").orderBy("t", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        total = marks(o.df, F.col("copies")).withColumn("c", F.sum("w").over(w))
        counted = total.groupBy("_src", "_id", "_ts", "copies").agg((at_event - before_window).alias("n_failures"))
        return _each(counted.where(F.col("n_failures") >= maxretry), "copies")

    def hot(rows: DataFrame) -> DataFrame:
        # one mark pair per instant, so that many rows at one instant stay one weighted mark
        instants = rows.groupBy("_src", "_ts").agg(F.sum("copies").alias("w"))
        total = Ordered.slices(marks(instants, F.col("w")), ["_src"], ["t", "kind"]).running_sum("c", F.col("w")).df
        full = total.groupBy("_src", "_ts").agg((at_event - before_window).alias("n_failures")) \
            .where(F.col("n_failures") >= maxretry)
        same = rows["_src"].eqNullSafe(full["_src"]) & (rows["_ts"] == full["_ts"])
        return _each(rows.join(full, same).select(rows["_src"], rows["_id"], rows["_ts"], "copies", "n_failures"), "copies")

    rows = _events_of(df, source, ts, event_id).groupBy("_src", "_id", "_ts").agg(F.count(F.lit(1)).alias("copies"))
    return by_key(rows, ["_src"], ["_ts", "_id"], step, hot_rows, hot).withColumnsRenamed(
        {"_src": source, "_id": event_id, "_ts": ts})


def ban_intervals(df: DataFrame, source: str = "source_ip", ts: str = "ts", event_id: str = "event_id",
                  maxretry: int = 5, findtime: int = 600, bantime: int = 3600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Bans per source: the failure that completes ``maxretry`` within ``findtime`` opens a ban of
    ``bantime`` seconds; failures inside it are ignored and counting restarts after it. Failures
    without a time are left out; repeated rows count each."""
    rows = _events_of(df, source, ts, event_id).where(F.col("_src").isNotNull())  # no source, nobody to ban

    def bans_of(events: pa.Table) -> pa.Table:
        # NULL ids first, as Spark sorts them
        events = events.take(pc.sort_indices(events, [("_ts", "ascending"), ("_id", "ascending")], null_placement="at_start"))
        t = events.column("_ts").to_numpy().astype("datetime64[us]").astype("int64")
        m = maxretry - 1
        full = np.flatnonzero(t[m:] - t[: max(len(t) - m, 0)] <= findtime * 1_000_000) + m
        start, found = 0, []
        while True:
            at = np.searchsorted(full, start + m)
            if at == len(full):
                break
            found.append(full[at])
            start = np.searchsorted(t, t[full[at]] + bantime * 1_000_000, side="left")
        return events.take(pa.array(found, pa.int64()))

    def step(o: Ordered) -> DataFrame:
        # ordinary sources only: at most hot_rows failures, or 1/MAX_HOT_KEYS of all
        return o.df.groupBy("_src").applyInArrow(bans_of, rows.schema)

    def hot(part: DataFrame) -> DataFrame:
        return _chained_bans(part, maxretry, findtime, bantime)

    return by_key(rows, ["_src"], ["_ts", "_id"], step, hot_rows, hot).select(
        F.col("_src").alias(source), F.col("_id").alias(event_id), F.col("_ts").alias("ban_start"),
        (F.col("_ts") + _secs(bantime)).alias("ban_end"))


def _chained_bans(rows: DataFrame, maxretry: int, findtime: int, bantime: int) -> DataFrame:
    """Bans of hot sources without gathering a source in one place.

    Rank the failures. A full point is a failure whose (maxretry-1)-th predecessor lies within
    findtime. A ban opened at one full point fixes the next possible one, so full points form a
    chain; the points on the chain from the first one are found by doubling the stride each round.
    """
    one = F.lit(1).cast("long")
    base = pin(Ordered.slices(rows, ["_src"], ["_ts", "_id"]).running_sum("r", one).df.drop("_slice"))
    back = base.select("_src", (F.col("r") + (maxretry - 1)).alias("r"), F.col("_ts").alias("back_ts"))
    full = F.coalesce(F.col("_ts") <= F.col("back_ts") + _secs(findtime), F.lit(False))
    flagged = base.join(back, ["_src", "r"], "left").select("_src", "_id", "_ts", "r", full.cast("long").alias("full"))
    # k: number of full points so far
    points = pin(Ordered.slices(flagged, ["_src"], ["r"]).running_sum("k", F.col("full")).df.drop("_slice"))
    bursts = points.where("full = 1")
    # how many failures lie before the end of a ban opened here
    marks = points.select("_src", F.col("_ts").alias("t"), F.lit(1).alias("kind"), F.col("r").alias("no"), one.alias("w")).unionByName(
        bursts.select("_src", (F.col("_ts") + _secs(bantime)).alias("t"), F.lit(0).alias("kind"), F.col("k").alias("no"),
                      F.lit(0).cast("long").alias("w")))
    before = Ordered.slices(marks, ["_src"], ["t", "kind", "no"]).running_sum("c", F.col("w")).df.where("kind = 0")
    resume = before.select("_src", F.col("no").alias("k"), (F.col("c") + (maxretry - 1)).alias("r"))
    if maxretry == 1:
        # the rank just before the first failure after the ban may be 0, where nothing has passed
        points = points.unionByName(points.select("_src", "_id", "_ts", F.lit(0).cast("long").alias("r"),
                                                  F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("full"))
                                    .dropDuplicates(["_src"]))
    jump = pin(
        resume.join(points.select("_src", "r", F.col("k").alias("passed")), ["_src", "r"])
        .select("_src", "k", (F.col("passed") + 1).alias("nk"))
        .join(bursts.select("_src", F.col("k").alias("nk")), ["_src", "nk"], "left_semi").select("_src", "k", "nk")
    )
    reach = bursts.where("k = 1").select("_src", "k")
    while not jump.isEmpty():
        ahead = reach.join(jump, ["_src", "k"]).select("_src", F.col("nk").alias("k"))
        reach = pin(reach.unionByName(ahead))
        far = jump.select("_src", F.col("k").alias("nk"), F.col("nk").alias("nnk"))
        jump = pin(jump.join(far, ["_src", "nk"]).select("_src", "k", F.col("nnk").alias("nk")))
    return bursts.join(reach, ["_src", "k"]).select("_src", "_ts", "_id").select(*rows.columns)


# ---- sequences ------------------------------------------------------------------------------

_A_START, _A_END, _B = 1, 2, 0  # at one instant B comes first: it is not later than A, but still within A's reach


def _marks(df: DataFrame, keys: dict[str, str], is_a: Column, is_b: Column, ts: str, event_id: str, within: int) -> DataFrame:
    """Points in time: the start and the end of every A row's reach, and every B row."""
    a_marks = F.array(
        F.struct(F.col("_ts").alias("t"), F.lit(_A_START).alias("kind")),
        F.struct((F.col("_ts") + _secs(within)).alias("t"), F.lit(_A_END).alias("kind")),
    )
    b_marks = F.array(F.struct(F.col("_ts").alias("t"), F.lit(_B).alias("kind")))
    none = F.filter(a_marks, lambda _: F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = df.where(yes(is_a) | yes(is_b)).select(
        *[F.col(c).alias(n) for n, c in keys.items()], F.col(event_id).alias("_id"), F.col(ts).alias("_ts"),
        yes(is_a).alias("a"), yes(is_b).alias("b"))
    for n in [*keys, "_ts"]:
        rows = rows.where(F.col(n).isNotNull())  # no entity, nothing to follow; no time, in no window
    # an event delivered more than once is one row that counts so often
    rows = rows.groupBy(*keys, "_id", "_ts", "a", "b").agg(F.count(F.lit(1)).alias("copies"))
    marks = F.concat(F.when(F.col("a"), a_marks).otherwise(none), F.when(F.col("b"), b_marks).otherwise(none))
    return rows.withColumn("m", F.explode(marks)).select(*keys, "_id", "_ts", "a", "b", "copies", "m.*")


_ORDER = ["t", "kind", "_id"]


def _at(kind: int, column: str = "c") -> Column:
    return F.max(F.when(F.col("kind") == kind, F.col(column)))


def _b_weight() -> Column:
    return F.when(F.col("kind") == _B, F.col("copies")).otherwise(0).cast("long")


def correlate_interval(df: DataFrame, is_a: Column, is_b: Column, key: str = "user_id", ts: str = "ts",
                       event_id: str = "event_id", within: int = 3600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """A rows followed by B rows of the same entity, strictly later and at most ``within`` seconds:
    the first follower, and how many there are. Rows without a time take no part; repeated rows count
    and are returned each. Running totals only; no pairs are formed."""

    event = ["_k", "_id", "_ts", "a", "b", "copies"]

    def cold(o: Ordered) -> DataFrame:
        back = Window.partitionBy("_k").orderBy(*[F.desc(c) for c in _ORDER]).rowsBetween(Window.unboundedPreceding, 0)
        b_row = F.when(F.col("kind") == _B, F.struct(F.col("_id").alias("b_id"), F.col("_ts").alias("b_ts")))
        df = o.running_sum("c", _b_weight()).df.withColumn("next_b", F.last(b_row, ignorenulls=True).over(back))
        one = df.groupBy(*event).agg((_at(_A_END) - _at(_A_START)).alias("n"), _at(_A_START, "next_b").alias("first_b"))
        return _each(one.where(F.col("n") > 0).select("_k", "_id", "_ts", "copies", "first_b.b_id", "first_b.b_ts", "n"), "copies")

    def hot(rows: DataFrame) -> DataFrame:
        total = Ordered.slices(rows, ["_k"], _ORDER).running_sum("c", _b_weight()).df
        # a B row is numbered by the first of its copies: the total before it, and one
        one = pin(total.groupBy(*event).agg(
            (_at(_B) - F.col("copies") + 1).alias("b_no"), (_at(_A_START) + 1).alias("no"), (_at(_A_END) - _at(_A_START)).alias("n")))
        b = one.where(F.col("b_no").isNotNull()).select(
            "_k", F.col("b_no").alias("no"), F.col("_id").alias("b_id"), F.col("_ts").alias("b_ts"))
        return _each(one.where(F.col("n") > 0).join(b, ["_k", "no"]).select("_k", "_id", "_ts", "copies", "b_id", "b_ts", "n"), "copies")

    marks = _marks(df, {"_k": key}, is_a, is_b, ts, event_id, within)
    return by_key(marks, ["_k"], _ORDER, cold, hot_rows, hot).withColumnsRenamed(
        {"_k": key, "_id": "a_id", "_ts": "a_ts", "n": "n_followers"})


def correlate_sources(df: DataFrame, is_a: Column, is_b: Column, key: str = "user_id", source: str = "source_system",
                      ts: str = "ts", event_id: str = "event_id", within: int = 3600,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """A rows followed by B rows of the same entity seen by another source system, with their number:
    all followers less those of the same source. Rows of unknown source are neither."""

    event = ["_k", "_s", "_id", "_ts", "a", "b", "copies"]

    def cold(o: Ordered) -> DataFrame:
        # both windows are served by one shuffle on the entity
        both = Ordered(o.running_sum("c", _b_weight()).df, ["_k", "_s"], _ORDER).running_sum("d", _b_weight()).df
        n = (_at(_A_END) - _at(_A_START)) - (_at(_A_END, "d") - _at(_A_START, "d"))
        found = both.groupBy(*event).agg(n.alias("n_other")).where(F.col("n_other") > 0)
        return _each(found.select("_k", "_id", "_ts", "copies", "n_other"), "copies")

    def hot(rows: DataFrame) -> DataFrame:
        def followers(keys: list[str], out: str) -> DataFrame:
            total = Ordered.slices(rows, keys, [*_ORDER, "_s"]).running_sum("c", _b_weight()).df
            return total.groupBy(*event).agg((_at(_A_END) - _at(_A_START)).alias(out)).where(F.col(out) > 0)

        every, same = followers(["_k"], "n"), followers(["_k", "_s"], "same")
        match = F.lit(True)
        for c in event:
            match = match & every[c].eqNullSafe(same[c])
        out = every.join(same, match, "left").select(
            every["_k"], every["_id"], every["_ts"], every["copies"], (F.col("n") - F.coalesce("same", F.lit(0))).alias("n_other"))
        return _each(out.where(F.col("n_other") > 0), "copies")

    marks = _marks(df, {"_k": key, "_s": source}, is_a, is_b, ts, event_id, within)
    return by_key(marks, ["_k"], _ORDER, cold, hot_rows, hot).withColumnsRenamed({"_k": key, "_id": "a_id", "_ts": "a_ts"})


# ---- rules and indicators -------------------------------------------------------------------

@dataclass(frozen=True)
class AttackRule:
    technique: str
    tactic: str
    field: str
    pattern: str


# Public ATT&CK execution techniques.
EXECUTION_RULES = (
    AttackRule("T1059.001", "execution", "process_name", "%powershell%"),
    AttackRule("T1059.003", "execution", "process_name", "%cmd.exe%"),
    AttackRule("T1059.004", "execution", "process_name", "%bash%"),
    AttackRule("T1059.006", "execution", "process_name", "%python%"),
)


def attack_map(df: DataFrame, rules: Sequence[AttackRule] = EXECUTION_RULES) -> DataFrame:
    """One row per event and matching rule. Rules become one projection, so there is no join."""
    hits = F.array_compact(F.array(*[
        F.when(F.col(r.field).like(r.pattern), F.struct(F.lit(r.technique).alias("technique"), F.lit(r.tactic).alias("tactic")))
        for r in rules
    ]))
    return df.withColumn("_hit", F.explode(hits)).select("*", "_hit.technique", "_hit.tactic").drop("_hit")


def match_indicators(df: DataFrame, feed: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Events touching a known indicator. ``feed``: indicator_type, indicator, threat; ``fields`` maps
    event columns to indicator types. A feed that was counted small is broadcast, otherwise the join
    shuffles on (type, value)."""
    feed = small_side(feed.dropDuplicates(["indicator_type", "indicator"]))
    seen = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.lit(t).alias("indicator_type"), F.col(c).alias("indicator"))
        for c, t in fields.items()
    ]))
    return df.withColumn("_s", seen).select("*", "_s.*").drop("_s").join(feed, ["indicator_type", "indicator"])


def indicator_flag(df: DataFrame, feed: DataFrame, column: str, indicator_type: str) -> DataFrame:
    """Events whose ``column`` is a known indicator of that type."""
    bad = small_side(feed.where(F.col("indicator_type") == indicator_type).select(F.col("indicator").alias(column)).distinct())
    return df.join(bad, column, "left_semi")


def enrich_source(df: DataFrame, metadata: DataFrame, key: str = "source_system") -> DataFrame:
    """Events with what is known about their source; unknown sources keep NULLs."""
    return df.join(small_side(metadata.dropDuplicates([key])), key, "left")


# ---- anomaly model --------------------------------------------------------------------------

def user_features(df: DataFrame, key: str = "user_id", event_type: str = "event_type",
                  types: Sequence[str] = ("click", "error", "purchase", "signup", "view")) -> DataFrame:
    """Events per type and entity, zero where there are none, and the share of errors. Events of no type of ``types``, or of none
    at all, are ``n_other``."""
    counts = [F.count_if(F.col(event_type) == t).alias(f"n_{t}") for t in types]
    other = F.count_if(~F.coalesce(F.col(event_type).isin(list(types)), F.lit(False))).alias("n_other")
    out = df.groupBy(key).agg(*counts, other, F.count(F.lit(1)).alias("n_total"))
    if "error" in types:
        out = out.withColumn("error_rate", F.round(F.col("n_error") / F.col("n_total"), 6))
    return out


def model_anomaly(features: DataFrame, key: str, columns: Sequence[str], k: int = 5, seed: int = 42,
                  quantile: float = 0.99) -> DataFrame:
    """Entities far from their cluster centre: standardized features, KMeans, distance above the
    exact given quantile. With one cluster the centre is the mean."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    packed = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(features)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(packed).transform(packed)
    data = pin(scaled.select(key, "_x"))  # one row per entity, read by every iteration
    if k == 1:
        placed, points = data.withColumn("cluster", F.lit(0)), [[0.0] * len(columns)]
    else:
        model = KMeans(featuresCol="_x", predictionCol="cluster", k=k, seed=seed).fit(data)
        placed, points = model.transform(data), model.clusterCenters()
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in points])
    diff = F.zip_with(vector_to_array("_x"), F.get(centers, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    scored = placed.withColumn(
        "distance", F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d)))
    scored = pin(scored.select(key, "cluster", "distance"))
    cut = exact_quantiles(scored, ["distance"], [quantile]).select("q").first()
    return scored.where(F.col("distance") > F.lit(cut.q if cut else None).cast("double"))
