"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Targets are whole parts of a period: a source with ``a`` of ``Q`` parts is due ``a`` blocks in every
``Q`` turns. Its block j (from 1) is released at turn floor((j - 1) Q / a) and due before turn
ceil(j Q / a). Earliest deadline first, among released blocks, keeps every source within one block
of its share at all times. The order repeats with the period, so it is worked out once for the
``Q`` turns of a period, from the targets alone; a document's turn then follows from the number of
its block by a join with that table of ``Q`` rows.

Numbering the documents of a source does not gather them: they are spread over small hash buckets,
numbered in each bucket, and shifted by the sizes of the buckets before.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntlake.llm.common import column, fresh
from huntlake.plans.sizes import local_rows

PERIOD = 1_000
BLOCK = 32
BUCKET_ROWS = 20_000
LANES = 256


def window_of(j: int, parts: int, period: int) -> tuple[int, int]:
    """Release and deadline of a source's block ``j``, counted from 1."""
    return (j - 1) * period // parts, -(-j * period // parts)


def turns(parts: list[int]) -> list[tuple[int, int, int, int, int]]:
    """One period, earliest deadline first: (lane, block, turn, release, deadline) for lanes with
    the given positive parts. Of equal deadlines the lane with fewer parts goes first, as its next
    window is farther away."""
    period = sum(parts)
    waiting, ready, out = [(0, lane, 1) for lane in range(len(parts))], [], []
    heapq.heapify(waiting)
    for turn in range(period):
        while waiting and waiting[0][0] <= turn:
            _, lane, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window_of(j, parts[lane], period)[1], parts[lane], lane, j))
        due, _, lane, j = heapq.heappop(ready)
        out.append((lane, j, turn, window_of(j, parts[lane], period)[0], due))
        if j < parts[lane]:
            heapq.heappush(waiting, (window_of(j + 1, parts[lane], period)[0], lane, j + 1))
    return out


def whole_parts(weights: list[float], period: int = PERIOD) -> list[int]:
    """Weights as positive whole parts of the period, by largest remainders after one part each."""
    if len(weights) > period:
        raise ValueError("more sources than turns in a period")
    total, rest = sum(weights), period - len(weights)
    exact = [max(0.0, w / total * period - 1) for w in weights]
    scale = rest / sum(exact) if sum(exact) else 0
    parts = [int(x * scale) for x in exact]
    by_remainder = sorted(range(len(weights)), key=lambda i: (parts[i] - exact[i] * scale, i))
    for i in by_remainder[: rest - sum(parts)]:
        parts[i] += 1
    return [p + 1 for p in parts]


def tempered_targets(docs: DataFrame, power: float = 0.5, lanes: int = LANES) -> list[tuple[str | None, float]]:
    """Sources with weights that grow as the number of their documents to ``power``. Beyond the
    ``lanes`` greatest sources all others share what they weigh together (they are not listed)."""
    source = column(docs, "source").cast("string")
    rows = docs.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(lanes).collect()
    return [(r.source, float(r.n) ** power) for r in rows]


def schedule(docs: DataFrame, targets: list[tuple[str | None, float]], other: float | None = None,
             block: int = BLOCK, period: int = PERIOD) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns named by the returned dict: ``block`` (from 1, in its lane),
    ``place`` (in its block), ``turn``, ``release``, ``deadline``.

    Sources without a target, NULL among them unless it has one, form one lane with weight ``other``
    (by default the mean of the targets). Every row gets one turn: repeated rows and equal ids count
    as documents of their own, rows without an id are spread by their place in the input. When a source
    runs out, its turns stay empty and the others keep their order. An empty table stays empty.
    """
    spark, n = docs.sparkSession, docs.count()
    weights = [w for _, w in targets]
    weights.append(other if other is not None else (sum(weights) / len(weights) if weights else 1.0))
    parts = whole_parts(weights, period)
    names = {k: fresh(docs, f"_{k}") for k in ("lane", "bucket", "order", "block", "place", "turn", "release", "deadline")}
    lane, bucket = names["lane"], names["bucket"]
    known = local_rows(spark, [(s, i) for i, (s, _) in enumerate(targets)], "k_source string, k_lane int")
    taken = {c: fresh(docs, c) for c in known.columns}
    known = known.select(*[F.col(c).alias(taken[c]) for c in known.columns])
    source = column(docs, "source").cast("string")
    placed = docs.join(F.broadcast(known), source.eqNullSafe(F.col(taken["k_source"])), "left")  # at most LANES rows
    placed = placed.withColumn(lane, F.coalesce(F.col(taken["k_lane"]), F.lit(len(targets)))).drop(*taken.values())
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), -1 - F.monotonically_increasing_id()))
    buckets = max(1, -(-n // BUCKET_ROWS))
    placed = placed.withColumn(names["order"], key).withColumn(bucket, F.pmod(F.col(names["order"]), F.lit(buckets)).cast("int"))

    sizes = placed.groupBy(lane, bucket).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy(lane).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    shift, sl, sb = (fresh(placed, x) for x in ("_shift", "_shift_lane", "_shift_bucket"))
    shifts = sizes.select(F.col(lane).alias(sl), F.col(bucket).alias(sb), F.coalesce(before, F.lit(0)).alias(shift))
    own = F.row_number().over(Window.partitionBy(lane, bucket).orderBy(names["order"], "doc_id"))
    number = fresh(placed, "_number")
    placed = placed.withColumn(number, own.cast("long"))
    placed = placed.join(shifts, (F.col(lane) == F.col(sl)) & (F.col(bucket) == F.col(sb)))
    index = F.col(number) - 1 + F.col(shift)
    placed = placed.withColumn(names["block"], F.floor(index / block) + 1).withColumn(names["place"], (index % block).cast("int"))

    table = local_rows(spark, turns(parts), "t_lane int, t_block int, t_turn int, t_release int, t_deadline int")
    sizes_of = F.get(F.array(*map(F.lit, parts)), F.col(lane)).cast("long")
    renamed = {c: fresh(placed, c) for c in table.columns}
    table = table.select(*[F.col(c).alias(renamed[c]) for c in table.columns])
    inside = ((F.col(names["block"]) - 1) % sizes_of + 1).cast("int")
    placed = placed.join(F.broadcast(table), (F.col(lane) == F.col(renamed["t_lane"])) & (inside == F.col(renamed["t_block"])))
    base = F.floor((F.col(names["block"]) - 1) / sizes_of) * sum(parts)
    for k in ("turn", "release", "deadline"):
        placed = placed.withColumn(names[k], (base + F.col(renamed[f"t_{k}"])).cast("long"))
    out = placed.drop(*renamed.values(), shift, sl, sb, number, lane, bucket, names["order"])
    return out, {k: names[k] for k in ("block", "place", "turn", "release", "deadline")}


def mixed(docs: DataFrame, targets: list[tuple[str | None, float]] | None = None) -> DataFrame:
    """``docs``, whole and with its columns, sorted by turn: read in order, the rows mix the sources
    to their targets."""
    found, names = schedule(docs, tempered_targets(docs) if targets is None else targets)
    return found.orderBy(names["turn"], names["place"]).drop(*names.values())
