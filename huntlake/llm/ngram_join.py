"""Near-duplicate documents: all links of Jaccard similarity 0.75 or more over word 5-grams.

The overlaps of all pairs are a product of the sparse document by n-gram matrix with its
transpose. It is worked out in blocks (slices of documents by ranges of n-grams), partial counts are
added up per pair, and size-derived bounds keep most of the product from being formed:

* Documents with equal sets are one row of the matrix.
* Linked sets of sizes a and b share at least t = ceil(3 (a + b) / 7) n-grams, so in any common
  order of n-grams they share one of the first a - ceil(3 a / 4) + 1 of the one and of the other.
  Only these columns are formed. Frequent n-grams come last in the order, so they hardly occur
  among them. The order decides the cost, never the result.
* Of the one whose last such n-gram comes first, all of the shared n-grams among its first are
  among the other's as well: fewer than t - ceil(3 a / 4) + 1 shared ones rule the pair out.
* So, too, what it alone has among its first is not shared: with u such columns it shares at most a - u n-grams, which must
  reach t. Members of a family that differ in too many places are ruled out by that before they are paired.
* Every column links its rows to its centre first, the row that has the fewest columns to itself: of a family of near copies it
  is the one that differs least from the others. What those links, once verified, put into one component is not paired
  again, only rows of different components are.
* A pair of those is formed at a column only if that can be the first one the two share: what either has before it is then not
  shared, nor are the columns behind it that no other component has, and the rest must reach t.

Remaining pairs are verified on their whole texts. Rows that share no column are linked with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.llm.common import Cache, id_and_text
from huntlake.llm.components import components
from huntlake.llm.exchange import (
    BLOCK, answers, block_batch, blocks, bucket_count, grouped, held, make_slices, per_document, read_answers, store, unpack,
)
from huntlake.llm.words import WordHashes, digest

WORDS = 5
#: An n-gram is frequent from so many documents on; at most so many are put last in the order.
FREQUENT = 20
FREQUENT_KEYS = 1_000_000


def _sets(texts: list[bytes], hashes: WordHashes, k: int) -> list[np.ndarray]:
    return [np.unique(x >> np.uint64(2)) for x in hashes.shingle_sets(texts, k)]


def _need(n: Column) -> Column:
    """ceil(3 n / 4)"""
    return F.floor((n * 3 + 3) / 4).cast("long")


def _describe(k: int):
    """``n`` and ``name`` of the set of each text, and the n-grams that three or more different sets
    of the slice have."""
    def make():
        hashes = WordHashes(lower=True)

        def step(texts):
            sizes, names, distinct = [], [], {}
            for found in _sets([t.encode() for t in texts], hashes, k):
                name = digest(found)
                distinct[name] = found
                sizes.append(len(found))
                names.append(name)
            values, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            often = counts >= 3
            return {"n": sizes, "name": names, "often": values[often].astype(np.int64), "counts": counts[often].astype(np.int32)}

        return step

    return make


def _first_columns(row: dict, frequent: np.ndarray, hashes: WordHashes, k: int) -> pa.RecordBatch:
    """The first n-grams, frequent ones last, of the sets whose class is at home in a slice."""
    wanted = set(row["own"])
    held = [x for x in unpack(row) if x[0] in wanted]
    keys, sizes, ends = [np.empty(0, np.uint64)], [], []
    for found in _sets([text for _, text in held], hashes, k):
        n, early = len(found), len(found)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
            late = frequent[at] == found
            found, early = np.concatenate([found[~late], found[late]]), n - int(late.sum())
        first = n - (3 * n + 3) // 4 + 1
        keys.append(found[:first] << np.uint64(2))
        sizes.append(n)
        ends.append(int(found[first - 1]) + ((first > early) << 62))
    return pa.RecordBatch.from_arrays([
        pa.array([row["slice"]], pa.int64()), pa.array([[name for name, _ in held]], pa.list_(pa.int64())),
        pa.array([sizes], pa.list_(pa.int32())), pa.array([ends], pa.list_(pa.int64())), pa.array([[len(x) for x in keys[1:]]], pa.list_(pa.int32())),
        pa.array([np.concatenate(keys).tobytes()], pa.binary())], names=["slice", "names", "sizes", "ends", "counts", "keys"])


def columns(slices: DataFrame, frequent: np.ndarray, k: int) -> DataFrame:
    """The matrix in blocks: per slice its sets (``names``, ``sizes``) and their first n-grams (``counts`` of ``keys``, up to the
    place ``ends`` in the order of all n-grams), stored, so that texts are read and hashed for it once. ``slices`` have ``own``: the sets to take."""
    shared = slices.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_KEYS numbers

    def run(batches):
        hashes = WordHashes(lower=True)
        for batch in batches:
            for i in range(batch.num_rows):
                yield _first_columns(batch.slice(i, 1).to_pylist()[0], shared.value, hashes, k)

    return store(slices.mapInArrow(run, "slice long, names array<long>, sizes array<int>, ends array<long>, counts array<int>, keys binary"), "columns")


class _Product:
    """Columns of the matrix, with ``own`` (name, owner) where sets belong to more than themselves."""

    def __init__(self, work: DataFrame, buckets: int):
        self.work, self.buckets = work, buckets

    def _map(self, use, schema: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    names, counts = np.array(row["names"], np.int64), np.array(row["counts"], np.int64)
                    owner = names
                    if row.get("own") is not None:
                        owners = {x["name"]: x["owner"] for x in row["own"]}
                        owner = np.array([owners[x] for x in row["names"]], np.int64)
                    set_at = np.repeat(np.arange(len(names)), counts)
                    yield use(row, np.frombuffer(row["keys"], np.uint64), owner, names, set_at)

        return self.work.mapInArrow(run, schema)

    def requests(self, only: bool = False, closest: bool = False) -> DataFrame:
        """Blocks of columns; ``only``: those that an earlier answer says several sets share. ``closest``: ask for the set that has the
        fewest columns to itself, instead of the least owner."""
        buckets = self.buckets

        def use(row, key, owner, names, set_at):
            tie = np.zeros_like(owner)
            if only:
                n, most, asked = _most(row, key, set_at, buckets)
                if closest:
                    owner, tie = n - most, names
                yes = asked[np.unique(key, return_inverse=True)[1]]
                key, set_at = key[yes], set_at[yes]
            key, owner, tie, several, _ = grouped(key, owner[set_at], tie[set_at])
            return block_batch(blocks(row["slice"], key, owner, tie, several, buckets))

        return self._map(use, BLOCK)

    def bounds(self) -> DataFrame:
        """(set_id, n, ends, most): of its ``n`` n-grams a set shares at most ``most`` with a set whose columns end at ``ends`` or later:
        such a set has among its columns whatever the two share of this one's, so it has none of those that this one alone asked for."""
        buckets = self.buckets

        def use(row, key, _, names, set_at):
            n, most, _ = _most(row, key, set_at, buckets)
            return pa.RecordBatch.from_pydict({"set_id": pa.array(names), "n": pa.array(n), "ends": pa.array(row["ends"], pa.int64()), "most": pa.array(most)})

        return self._map(use, "set_id long, n long, ends long, most long")

    def star(self) -> DataFrame:
        """(a, b, c): ``b`` shares ``c`` columns with ``a``, the centre of each of those columns."""
        buckets = self.buckets

        def use(row, key, _, names, set_at):
            known, inverse = np.unique(key, return_inverse=True)
            asked = read_answers(known, row["answers"], buckets)[0]
            centre = np.zeros(len(known), np.int64)
            centre[asked] = read_answers(known[asked], row["centres"], buckets)[2]
            name, centre = names[set_at], centre[inverse]
            yes = asked[inverse] & (centre != name)
            pairs, count = np.unique(np.stack([centre[yes], name[yes]], 1), axis=0, return_counts=True)
            return pa.RecordBatch.from_pydict({
                "a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()),
                "c": pa.array(count, pa.int64())})

        return self._map(use, "a long, b long, c long")

    def mixed(self) -> DataFrame:
        """(key, root, set_id, n, ends) of columns that sets of several components share. ``plain``: the n-grams that the set has from
        this column on. ``left``: those of them that a set of another component can have if its columns end no earlier, since it would
        have asked for them."""
        buckets = self.buckets

        def use(row, key, owner, names, set_at):
            known, inverse = np.unique(key, return_inverse=True)
            asked, yes = read_answers(known, row["answers"], buckets)[0], np.zeros(len(known), bool)
            yes[asked] = read_answers(known[asked], row["roots"], buckets)[0]
            yes = yes[inverse]
            counts, n = np.array(row["counts"], np.int64), np.array(row["sizes"], np.int64)
            plain = n[set_at] - (np.arange(len(key)) - (np.cumsum(counts) - counts)[set_at])
            own = np.cumsum(~yes)  # columns of one component only, of a set and of all before it
            total = np.r_[0, own][np.cumsum(counts)]
            left, at = plain - (total[set_at] - own), set_at[yes]
            return pa.RecordBatch.from_pydict({
                "key": pa.array(key[yes].astype(np.int64)), "root": pa.array(owner[at]), "set_id": pa.array(names[at]),
                "n": pa.array(n[at]), "ends": pa.array(np.array(row["ends"], np.int64)[at]), "plain": pa.array(plain[yes]), "left": pa.array(left[yes])})

        return self._map(use, "key long, root long, set_id long, n long, ends long, plain long, left long")


def _most(row: dict, key: np.ndarray, set_at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of a slice's sets, what they may share at most, and which of the different columns several sets share."""
    known, inverse = np.unique(key, return_inverse=True)
    asked = read_answers(known, row["answers"], buckets)[0]
    n = np.array(row["sizes"], np.int64)
    return n, n - np.bincount(set_at[~asked[inverse]], minlength=len(n)), asked


def _bodies(slices: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``set_id`` and packed text of the sets in ``pairs``."""
    wanted = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct().join(classes, "name")
    wanted = wanted.groupBy("slice").agg(F.collect_list("name").alias("wanted"))

    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                take = set(row["wanted"])
                found = [(name, press(text)) for name, text in unpack(row) if name in take]
                yield pa.RecordBatch.from_pydict({
                    "set_id": pa.array([x[0] for x in found], pa.int64()), "body": pa.array([x[1] for x in found], pa.binary())})

    return slices.join(wanted, "slice").mapInArrow(run, "set_id long, body binary")


def _linked(pairs: DataFrame, bodies: DataFrame, k: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have 100 * intersection >= 75 * union."""
    both = (
        pairs.select("a", "b")
        .join(bodies.select(F.col("set_id").alias("b"), F.col("body").alias("body_b")), "b")
        .join(bodies.select(F.col("set_id").alias("a"), F.col("body").alias("body_a")), "a")
    )

    def run(batches):
        hashes, open_ = WordHashes(lower=True), zstandard.ZstdDecompressor().decompress
        found = Cache(lambda body: _sets([open_(body)], hashes, k)[0], 64)
        for batch in batches:
            keep = []
            for body_a, body_b in zip(batch.column("body_a").to_pylist(), batch.column("body_b").to_pylist()):
                a, b = found[body_a], found[body_b]
                inside = np.intersect1d(a, b, assume_unique=True).size
                keep.append(100 * inside >= 75 * (len(a) + len(b) - inside))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.select("a", "b", "body_a", "body_b").mapInArrow(run, "a long, b long")


def _shared(a: Column, b: Column) -> Column:
    """ceil(3 (a + b) / 7): n-grams that linked sets of these sizes share"""
    return F.floor((3 * (a + b) + 6) / 7)


def _side(rows: DataFrame, x: str, names: tuple[str, ...], **bounds: str | Column) -> DataFrame:
    """Columns ``names`` of ``rows``, and the ``bounds`` of the sets of a row as ``_may_link`` takes them for ``x``."""
    return rows.select(*names, *[(F.col(c) if isinstance(c, str) else c).alias(f"{k}_{x}") for k, c in bounds.items()])


def _may_link(a: str, b: str) -> Column:
    """A set of ``a`` and one of ``b`` can be linked: sizes ``low`` to ``high``, whose columns end between ``from`` and ``to``, sharing at
    most ``left`` with sets whose columns end no earlier and ``plain`` with others."""
    of = lambda name, x: F.col(f"{name}_{x}")
    most = lambda x, y: F.when(of("to", x) <= of("from", y), of("left", x)).otherwise(of("plain", x))
    sizes = (100 * of("high", a) >= 75 * of("low", b)) & (100 * of("high", b) >= 75 * of("low", a))
    return sizes & (F.least(most(a, b), most(b, a)) >= _shared(of("low", a), of("low", b)))


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pairs`` that may be linked, with ``least``: the shared columns that a linked pair has."""
    side = lambda x: _side(sizes.withColumnRenamed("set_id", x), x, (x,), low="n", high="n", **{"from": "ends"}, to="ends", plain="n", left="most")
    n_a, n_b = F.col("low_a"), F.col("low_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link("a", "b"))
    return both.withColumn("least", F.greatest(_shared(n_a, n_b) - _need(F.greatest(n_a, n_b)) + 1, F.lit(1)))


def _candidates(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that can be linked, as far as columns can say. Every linked pair is found at
    the first column that the two share."""
    # partners have at least the size that is the least in the column, and three quarters of a set's own
    least = mixed.groupBy("key").agg(F.min("n").alias("least"))
    near = mixed.join(least, "key").where(F.col("plain") >= _shared(F.col("n"), F.greatest("least", _need(F.col("n"))))).drop("least")
    near = store(near, "near")
    heads = lambda x: _side(
        near.groupBy("key", F.col("root").alias(f"root_{x}")).agg(
            F.min("n").alias("low"), F.max("n").alias("high"), F.min("ends").alias("from"), F.max("ends").alias("to"),
            F.max("plain").alias("plain"), F.max("left").alias("left")),
        x, ("key", f"root_{x}"), **{c: c for c in ("low", "high", "from", "to", "plain", "left")})
    of = lambda root, x: _side(
        near.select("key", F.col("root").alias(root), F.col("set_id").alias(x), "n", "ends", "plain", "left"),
        x, ("key", root, x), low="n", high="n", **{"from": "ends"}, to="ends", plain="plain", left="left")
    found = heads("a").join(heads("b"), "key").where("root_a < root_b").where(_may_link("a", "b"))
    found = found.drop(*[c for c in found.columns if c.endswith("_a") and c != "root_a"])
    found = found.join(of("root_a", "x"), ["key", "root_a"]).where(_may_link("x", "b")).drop("root_a")
    found = found.drop(*[c for c in found.columns if c.endswith("_b") and c != "root_b"])
    found = found.join(of("root_b", "y"), ["key", "root_b"]).where(_may_link("x", "y"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (least id that links reach).

    A document of fewer than ``k`` words has its whole sequence as its only n-gram; one without
    words, or with NULL text, has none, is linked with nothing and is its own component. Repeated
    rows give one result each; rows that share an id are equal copies or separate texts with that
    id. A row without an id is linked with nothing and has no component_id. An empty table gives no rows. Other columns are
    ignored. Links are exact up to collisions of 62-bit hashes.
    """
    # a small table costs little in a shuffle; each broadcast, though, costs the driver a thread and memory that it keeps
    with held(docs.sparkSession, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        return _near_duplicates(docs, k)


def _near_duplicates(docs: DataFrame, k: int) -> DataFrame:
    rows = id_and_text(docs)
    slices = make_slices(rows, _describe(k), ", often array<long>, counts array<int>")
    counted = (
        slices.select(F.explode(F.arrays_zip("often", "counts")).alias("x"))
        .groupBy(F.col("x.often").alias("key")).agg(F.sum("x.counts").alias("n")).where(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "key").limit(FREQUENT_KEYS).select("key").toArrow()
    )
    frequent = np.sort(counted.column("key").to_numpy().astype(np.uint64))
    owned = per_document(slices, "doc_id", "n", "name")
    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = owned.where(usable).groupBy("name").agg(
        F.min("n").alias("n"), F.min(F.struct("doc_id", "slice")).alias("at"))
    classes = store(classes.select("name", "n", F.col("at.doc_id").alias("doc_id"), F.col("at.slice").alias("slice")), "sets")
    total = classes.agg(F.sum(F.col("n") - _need(F.col("n")) + 1)).first()[0] or 0
    packed = slices.select("slice", "packed", "sizes", "body")
    buckets = bucket_count(docs, total)
    home = classes.groupBy("slice").agg(F.collect_list("name").alias("own"))
    matrix = columns(packed.join(home, "slice"), frequent, k)
    shared = store(answers(_Product(matrix, buckets).requests()), "shared")
    known = _Product(matrix.join(shared, "slice"), buckets)
    sizes = store(known.bounds(), "bounds")
    centres = store(answers(known.requests(only=True, closest=True)), "centres").withColumnRenamed("answers", "centres")
    star = _sized(_Product(known.work.join(centres, "slice"), buckets).star(), sizes)
    star = store(star.where(F.col("c") * 3 >= F.col("least")).select("a", "b"), "star")
    first = store(_linked(star, _bodies(packed, classes, star), k), "first")
    root = components(first).withColumnRenamed("node", "name")

    owners = classes.join(root, "name", "left").select("slice", F.struct("name", F.coalesce("root", "name").alias("owner")).alias("x"))
    grown = matrix.join(owners.groupBy("slice").agg(F.collect_list("x").alias("own")), "slice").join(shared, "slice")
    roots = store(answers(_Product(grown, buckets).requests(only=True)), "roots").withColumnRenamed("answers", "roots")
    mixed = store(_Product(grown.join(roots, "slice"), buckets).mixed(), "mixed")
    cross = store(_candidates(mixed), "cross")
    second = store(_linked(cross, _bodies(packed, classes, cross), k), "second")
    edges = first.union(second)
    root = components(edges).withColumnRenamed("node", "name") if second.limit(1).count() else root

    rooted = classes.select("name", "doc_id").join(root, "name", "left").select(
        "name", "doc_id", F.coalesce("root", "name").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(least, "root").select("name", "component_id")
    linked = owned.where(usable).join(named, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    unlinked = owned.where(~usable).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(unlinked)
