"""Trie of conversation prefixes by tables of minimal perfect hashes.

Every prefix of a conversation has a digest that grows turn by turn (sums of hashes of turn and place, over 120 bits),
so that prefixes are compared without their texts. Equal conversations are put together first. The prefixes of the
rest are dealt to shards by conversation and segment, whatever they begin with, so a first turn that a third
of all conversations share is not one shard. A shard

* enumerates its distinct digests and gives each a slot by a minimal perfect hash (``Slots``); digest, parent and
  last turn of every row are compared with those of its slot, and the whole trie is built anew with other hashes if one differs;
* scatters counts into flat arrays by slot and adds them to the arrays of the parents' slots, deepest first.

What shards say about one node is summed. First they count members; then each node's own saving and
whether it is a leaf is given to one owner, its least member, and the shards add up subtrees in the same way. A segment
that goes on in another shard starts from what the later segments own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from huntlake.llm.common import column
from huntlake.llm.exchange import store
from huntlake.llm.words import mixed
from huntlake.plans.ordered import by_key

#: Rows of a shard, and turns of one conversation that stay together.
SHARD_ROWS, SEGMENT = 200_000, 20_000
BLOCK, SHARED = 20, 4
NODE = ("d", "p", "q")


class Slots:
    """A minimal perfect hash: a number from 0 to n - 1 for each of n distinct 64-bit keys. Keys that meet
    in a place of one level go on to the next; a key's number is the rank of its place. Other keys
    get any number or -1, so the caller compares what the slot holds."""

    def __init__(self, keys: np.ndarray):
        self.levels, placed, rest = [], 0, keys
        while len(rest):
            size = max(64, len(rest) * 3 // 2)
            at = self._at(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, alone, placed + np.cumsum(alone) - 1))
            placed += int(alone.sum())
            rest = rest[~alone[at]]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self.levels):
            at = self._at(keys[rest], level, size)
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out


class Table:
    """Nodes of a shard in slots: ``node`` (depth and digest) and ``parent`` (a slot, or -1 when it is in another segment)."""

    def __init__(self, node: np.ndarray, above: np.ndarray, segment: int):
        """``node``: rows of (d, p, q), repeated or not; ``above``: p, q of their parents."""
        distinct, first, self.row = np.unique(node, axis=0, return_index=True, return_inverse=True)
        self.row, salt = self.row.reshape(-1), 0
        while len(np.unique(keys := self._keys(distinct, salt))) < len(distinct):
            salt += 1
        slots = Slots(keys)
        slot = slots(keys)
        self.node = np.empty_like(distinct)
        self.node[slot] = distinct
        self.first = np.empty(len(distinct), np.int64)
        self.first[slot] = first
        self.row = slot[self.row]
        want = np.c_[self.node[:, 0] - 1, above[self.first]]
        self.parent = slots(self._keys(want, salt))
        here = self.parent >= 0
        here[here] = (self.node[self.parent[here]] == want[here]).all(axis=1)
        self.parent[~here | ((self.node[:, 0] - 1) % segment == 0)] = -1
        depth = self.node[:, 0]
        self.deepest_first = np.split(order := np.argsort(-depth, kind="stable"), np.flatnonzero(np.diff(depth[order])) + 1)

    @staticmethod
    def _keys(node: np.ndarray, salt: int) -> np.ndarray:
        d, p, q = (np.ascontiguousarray(node[:, i]).view(np.uint64) for i in range(3))
        return mixed(p + np.uint64(salt)) ^ mixed(mixed(q) + d)

    def scatter(self, how: np.ufunc, start: int, values: np.ndarray) -> np.ndarray:
        """Values of rows, put together in their slots and then in the slots of all their ancestors."""
        out = np.full(len(self.node), start, np.int64)
        how.at(out, self.row, values)
        for slots in self.deepest_first:
            slots = slots[self.parent[slots] >= 0]
            how.at(out, self.parent[slots], out[slots])
        return out


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in names]


_COUNTED = "d long, p long, q long, above_p long, above_q long, n long, member long, words long, turn binary, clash boolean"


def _count(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Members of the nodes of a shard."""
    t = pa.Table.from_batches(batches)
    d, p, q, above_p, above_q, n, member, words = _numbers(t, *NODE, "above_p", "above_q", "n", "member", "words")
    turns = t.column("turn").combine_chunks()
    turn = np.frombuffer(b"".join(turns.to_pylist()), np.int64).reshape(-1, 4)
    above = np.c_[above_p, above_q]
    slots = Table(np.c_[d, p, q], above, segment)
    first = slots.first
    clash = np.zeros(len(first), bool)
    differ = (above != above[first][slots.row]).any(axis=1) | (turn != turn[first][slots.row]).any(axis=1)
    clash[slots.row[differ]] = True
    yield pa.RecordBatch.from_arrays([
        *[pa.array(np.ascontiguousarray(slots.node[:, i])) for i in range(3)], pa.array(above_p[first]), pa.array(above_q[first]),
        pa.array(slots.scatter(np.add, 0, n)), pa.array(slots.scatter(np.minimum, np.iinfo(np.int64).max, member)),
        pa.array(words[first]), turns.take(pa.array(first)), pa.array(clash),
    ], names=[f.split()[0] for f in _COUNTED.split(", ")])


_SUMMED = "d long, p long, q long, saved_tokens long, n_leaves long"


def _sum(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Sums over the subtrees of the nodes of a shard, of what is owned in it."""
    t = pa.Table.from_batches(batches)
    d, p, q, above_p, above_q, saved, leaves = _numbers(t, *NODE, "above_p", "above_q", "saved_tokens", "n_leaves")
    slots = Table(np.c_[d, p, q], np.c_[above_p, above_q], segment)
    yield pa.RecordBatch.from_arrays(
        [*[pa.array(np.ascontiguousarray(slots.node[:, i])) for i in range(3)],
         pa.array(slots.scatter(np.add, 0, saved)), pa.array(slots.scatter(np.add, 0, leaves))], names=[f.split()[0] for f in _SUMMED.split(", ")])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, from rows sorted by node and id. Only a running hash is held."""
    now, running = None, None

    def row():
        return pa.RecordBatch.from_pydict({**{c: pa.array([v], pa.int64()) for c, v in zip(NODE, now)}, "ends_sha256": pa.array([running.hexdigest()])})

    for batch in batches:
        node = np.c_[tuple(batch.column(c).to_numpy() for c in NODE)]
        ids = batch.column("conv_id").to_pylist()
        start = np.r_[0, np.flatnonzero((node[1:] != node[:-1]).any(axis=1)) + 1, len(node)].tolist() if len(node) else [0]
        for lo, hi in zip(start[:-1], start[1:]):
            text = ",".join(map(str, ids[lo:hi])).encode()
            if now == tuple(node[lo].tolist()):
                running.update(b"," + text)
            else:
                if now is not None:
                    yield row()
                now, running = tuple(node[lo].tolist()), hashlib.sha256(text)
    if now is not None:
        yield row()


def rebuilt(conversations: DataFrame, block: int = BLOCK, shared: int = SHARED, **options) -> tuple[DataFrame, DataFrame]:
    """(``conv_id``, ``d``, ``turn`` (SHA-256 of role and text), ``words``) for each turn of each rebuilt conversation, and all
    ``conv_id``. A conversation c begins with the first h turns of c - c % ``block``, h = crc32(c) % ``shared``, and goes on with its
    own after the first h. Turns with equal numbers are taken by role, then by the SHA-256 of role and text."""
    role, text = (F.coalesce(column(conversations, c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        column(conversations, "conv_id").cast("long").alias("conv_id"), column(conversations, "turn").cast("long").alias("no"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    ).where("conv_id IS NOT NULL")
    c = F.col("conv_id")
    placed = store(by_key(turns, ["conv_id"], ["no", "role", "turn"], lambda o: o.running_sum("place", F.lit(1)).df, **options).select(
        "conv_id", "place", "turn", "words"), "conversation-turns")
    base, h = c - c % block, F.crc32(c.cast("string").cast("binary")) % shared
    heads = (
        placed.where((c % block == 0) & (F.col("place") < shared)).groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "turn", "words"))).alias("head"))  # fewer than `shared` turns
        .select(F.col("conv_id").alias("base"), "head")
    )
    known = F.coalesce(F.size("head"), F.lit(0))
    ids = placed.select("conv_id").distinct()
    before = (
        ids.select("conv_id", base.alias("base"), h.alias("h")).where("h > 0").join(heads, "base")
        .select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t"))
        .select("conv_id", F.col("t.place").alias("d"), "t.turn", "t.words")
    )
    own = (
        placed.select("*", base.alias("base"), h.alias("h")).where("place > h").join(heads.select("base", known.alias("known")), "base", "left")
        .select("conv_id", (F.col("place") - F.col("h") + F.least("h", F.coalesce("known", F.lit(0)))).alias("d"), "turn", "words")
    )
    return store(before.unionByName(own), "conversation-rebuilt"), ids


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _with_digests(turns: DataFrame, seed: int, **options) -> DataFrame:
    """``p``, ``q``: the digest of the prefix up to a turn; ``above_p``, ``above_q``: up to the one before."""
    hashes = [F.xxhash64(F.lit(seed + i), "d", "turn") for i in (0, 1)]
    terms = {"s0": _low(hashes[0]), "s1": _low(F.shiftrightunsigned(hashes[0], 32)), "s2": _low(hashes[1]), "s3": _low(F.shiftrightunsigned(hashes[1], 32))}

    def sums(o):
        for name, term in terms.items():
            o = o.running_sum(name, term)
        return o.df

    def packed(a: Column, b: Column) -> Column:
        return F.shiftleft(a.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), 32).bitwiseOR(_low(b))

    s, t = [F.col(n) for n in terms], [F.col(n) - x for n, x in terms.items()]
    return by_key(turns, ["conv_id"], ["d"], sums, **options).select(
        "conv_id", "d", "turn", "words", packed(s[0], s[1]).alias("p"), packed(s[2], s[3]).alias("q"),
        packed(t[0], t[1]).alias("above_p"), packed(t[2], t[3]).alias("above_q"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, shared: int = SHARED, shard_rows: int = SHARD_ROWS, segment: int = SEGMENT,
                seed: int = 1, **options) -> DataFrame:
    """One row per node: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``.

    NULL role and text are empty, NULL turn numbers come first, rows without a conversation id are left out, repeated
    rows are turns like others; an empty table gives no rows; other columns are ignored. A conversation of any number
    of turns is cut into segments; its texts are read once and not moved.
    """
    turns, ids = rebuilt(conversations, block, shared, **options)
    zero = [F.lit(0).cast("long").alias(c) for c in NODE]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count(batches, segment)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sum(batches, segment)

    while True:
        steps = store(_with_digests(turns, seed, **options), "conversation-prefixes")
        last = steps.groupBy("conv_id").agg(F.max("d").alias("d"), F.max_by(F.struct("p", "q"), "d").alias("e")).select("conv_id", "d", "e.p", "e.q")
        ends = last.unionByName(ids.join(last.select("conv_id"), "conv_id", "left_anti").select("conv_id", *zero))
        ends = store(ends, "conversation-ends")
        # of equal conversations the least stands for all
        alike = ends.where("d > 0").groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
        part = F.floor((F.col("d") - 1) / segment)
        paths = steps.join(alike.select("conv_id", "n", F.col("d").alias("length")), "conv_id").withColumn("part", part)
        tail = (F.col("d") == F.col("length")) | (F.col("d") % segment == 0)
        paths = store(paths.select("conv_id", "part", *NODE, "above_p", "above_q", "turn", "words", F.when(tail, F.col("n")).otherwise(0).alias("n")), "conversation-paths")
        shards = max(1, -(-paths.count() // shard_rows))
        shard = F.pmod(F.xxhash64("conv_id", "part"), F.lit(shards)).alias("shard")
        counted = paths.select("*", shard, F.col("conv_id").alias("member")).groupBy("shard").applyInArrow(members, _COUNTED)
        same = (F.min(F.struct("above_p", "above_q", "turn")) == F.max(F.struct("above_p", "above_q", "turn")))
        nodes = store(counted.groupBy(*NODE).agg(
            F.first("above_p").alias("above_p"), F.first("above_q").alias("above_q"), F.sum("n").alias("n_convs"), F.min("member").alias("conv_id"),
            F.first("words").alias("words"), (F.max("clash") | ~same).alias("clash")), "conversation-nodes")
        if nodes.where("clash").isEmpty():
            break
        seed += 2
    root = ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    nodes = nodes.drop("clash").unionByName(root.select(*zero, F.lit(0).cast("long").alias("above_p"), F.lit(0).cast("long").alias("above_q"),
                                                        "n_convs", "conv_id", F.lit(0).cast("long").alias("words")))
    said = nodes.withColumn("n_children", F.lit(0).cast("long")).unionByName(
        nodes.where("d > 0").select((F.col("d") - 1).alias("d"), F.col("above_p").alias("p"), F.col("above_q").alias("q"), F.lit(1).cast("long").alias("n_children")),
        allowMissingColumns=True)
    kept = ("above_p", "above_q", "n_convs", "conv_id", "words")
    nodes = store(said.groupBy(*NODE).agg(*[F.max(c).alias(c) for c in kept], F.sum("n_children").alias("n_children")), "conversation-trie")

    owned = nodes.select(*NODE, "above_p", "above_q", "conv_id", ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
                         (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    values = owned.where("d > 0").withColumn("part", part)
    nothing = [F.lit(0).cast("long").alias(c) for c in ("saved_tokens", "n_leaves")]
    rows = paths.select(*NODE, "above_p", "above_q", "conv_id", "part", *nothing).unionByName(values)
    if (nodes.agg(F.max("d")).first()[0] or 0) > segment:
        later = Window.partitionBy("conv_id").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
        sums = values.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in ("saved_tokens", "n_leaves")])
        # a row for each segment, also where nothing is owned, so that what comes later is carried through
        sums = paths.select("conv_id", "part").distinct().join(sums, ["conv_id", "part"], "left")
        carried = sums.select("conv_id", "part", *[F.sum(c).over(later).alias(c) for c in ("saved_tokens", "n_leaves")]).dropna()
        tails = paths.where(F.col("d") % segment == 0).select(*NODE, "above_p", "above_q", "conv_id", "part")
        rows = rows.unionByName(tails.join(carried, ["conv_id", "part"]).select(*rows.columns))
    summed = rows.select("*", shard).groupBy("shard").applyInArrow(subtrees, _SUMMED)
    # the root belongs to no shard
    summed = summed.unionByName(owned.agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves")).select(*zero, "saved_tokens", "n_leaves"))
    hashed = ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(_ends, "d long, p long, q long, ends_sha256 string")
    all_ = nodes.unionByName(summed, allowMissingColumns=True).unionByName(hashed, allowMissingColumns=True).groupBy(*NODE).agg(
        *[F.max(c).alias(c) for c in (*kept, "n_children")], F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"),
        F.coalesce(F.max("ends_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")).where("n_convs IS NOT NULL")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("p").alias("above_p"), F.col("q").alias("above_q"), F.col("conv_id").alias("parent_conv_id"))
    return all_.join(above, ["d", "above_p", "above_q"], "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
