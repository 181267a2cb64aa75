"""Merkle-tree fingerprints of documents, in DataFrame functions only.

A text is cut into sections (at empty lines), a section into paragraphs (lines), a paragraph into
passages of at most ``PASSAGE`` characters that end at punctuation where there is any. Cutting is
lossless. A passage, the leaf, has a cheap digest of 64 bits, which only measures likeness. A paragraph's digest is the
head of the SHA-256 of its text and its leaves, a section's that of its paragraphs, and the root is the full SHA-256 over all
below. Roots are equal exactly for equal texts (up to collisions of SHA-256 heads), and walking down the differing branches
of two trees finds where they were edited.

The fingerprint is the tree in print: ``root/section=paragraph:passage,passage;paragraph:…/section=…``; passages in upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntlake.functions.common import let
from huntlake.llm.common import column, fresh
from huntlake.plans.sizes import small_side
from huntlake.session import pin

PASSAGE = 32
DIGEST = 16
#: Rows of a range of ids that is put in order together.
SLICE_ROWS = 2_000
QUANTILES = 1_000
_CUT = rf"[^.,;:!?|]{{1,{PASSAGE}}}[.,;:!?|]{{0,{PASSAGE}}}|[.,;:!?|]{{1,{PASSAGE}}}"


def _head(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, DIGEST)


def _leaf(text: Column) -> Column:
    return F.lpad(F.hex(F.xxhash64(text)), DIGEST, "0")


def _passages(text: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_CUT), F.lit(0)), _leaf), ",")


def fingerprint(text: Column) -> Column:
    """The printed tree of a text; NULL counts as empty, and the empty text has a tree of its own."""
    def named(body: Column, mark: str) -> Column:
        return let(body, lambda b: F.concat(_head(b), F.lit(mark), b))

    def section(part: Column) -> Column:
        lines = F.transform(F.split(part, "\n"), lambda line: let(_passages(line), lambda p: F.concat(
            _head(F.concat(p, F.lit(":"), line)), F.lit(":"), p)))
        return named(F.array_join(lines, ";"), "=")

    sections = F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section), "/")
    return let(sections, lambda s: F.concat(F.sha2(s, 256), F.lit("/"), s))


def root(tree: Column) -> Column:
    return F.substring_index(tree, "/", 1)


def passages(tree: Column) -> Column:
    """Distinct passage digests of a printed tree."""
    bare = F.regexp_replace(F.substring(tree, 66, 1 << 30), rf"[0-9a-f]{{{DIGEST}}}[=:]", "")
    return F.array_distinct(F.filter(F.split(bare, "[,;/]"), lambda d: d != ""))


def likeness(one: Column, other: Column) -> Column:
    """Between 0 and 1: shared passages, twice, over the passages of both. Equal roots give 1; a
    text without passages is like an equal one only."""
    a, b = passages(one), passages(other)
    both = F.size(a) + F.size(b)
    shared = F.size(F.array_intersect(a, b)) * 2 / both
    return F.when(root(one) == root(other), F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(shared)


def edits(one: Column, other: Column) -> Column:
    """Branches of ``other`` that ``one`` lacks: array of (section, paragraph), counted from 0. Only
    sections whose digests differ are opened."""
    def branches(tree: Column) -> Column:
        return F.split(F.substring(tree, 66, 1 << 30), "/")

    def head(branch: Column, mark: str) -> Column:
        return F.substring_index(branch, mark, 1)

    mine = F.transform(branches(one), lambda s: head(s, "="))
    paragraphs = F.flatten(F.transform(branches(one), lambda s: F.transform(
        F.split(F.substring_index(s, "=", -1), ";"), lambda p: head(p, ":"))))

    def inside(section: Column, at: Column) -> Column:
        lines = F.split(F.substring_index(section, "=", -1), ";")
        marked = F.transform(lines, lambda p, i: F.when(
            ~F.array_contains(paragraphs, head(p, ":")), F.struct(at.alias("section"), i.alias("paragraph"))))
        return F.filter(marked, lambda m: m.isNotNull())

    empty = F.array().cast("array<struct<section:int,paragraph:int>>")
    return F.flatten(F.transform(branches(other), lambda s, i: F.when(
        F.array_contains(mine, head(s, "=")), empty).otherwise(inside(s, i))))


def n_edited(one: Column, other: Column) -> Column:
    """How many different paragraphs of ``other`` are not in ``one``, found by opening only the sections that differ."""
    def branches(tree: Column) -> Column:
        return F.split(F.substring(tree, 66, 1 << 30), "/")

    def paragraphs(sections: Column) -> Column:
        return F.flatten(F.transform(sections, lambda s: F.transform(
            F.split(F.substring_index(s, "=", -1), ";"), lambda p: F.substring_index(p, ":", 1))))

    new = let(F.array_except(branches(other), branches(one)), lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(
        F.size(F.array_except(paragraphs(s), paragraphs(branches(one))))))
    return F.when(root(one) == root(other), F.lit(0)).otherwise(new).cast("long")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the printed tree in ``out``.

    NULL text counts as empty. Rows keep their number and columns; repeated rows get equal
    fingerprints; an empty table stays empty. ``out`` must not be a column of ``docs``.
    """
    if fresh(docs, out) != out:
        raise ValueError(f"{out} is already a column")
    return docs.withColumn(out, fingerprint(column(docs, text)))


def _slice(rows: DataFrame, slice_rows: int) -> Column:
    """A number that grows with ``key``, equal for about ``slice_rows`` rows: ranges between quantiles, of which there are at most
    ``QUANTILES``, each cut into ranges of equal width. It only says what is put in order together."""
    n = rows.count()
    parts = max(1, -(-n // slice_rows))
    wide = min(parts, QUANTILES)
    fine = -(-parts // wide)
    marks = [i / wide for i in range(wide + 1)]
    bounds = sorted(set(rows.agg(F.percentile_approx("key", marks, 100 * wide)).first()[0] or [0]))
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    # how many bounds, of those inside, are not above the key, by halving
    inside, at = len(bounds) - 2, F.lit(0)
    for step in (1 << i for i in reversed(range(max(inside, 0).bit_length()))):
        at = let(at, lambda p, step=step: F.when((p + step <= inside) & (F.get(edges, p + step) <= F.col("key")), p + step).otherwise(p))

    def cut(p: Column) -> Column:
        lo, hi = F.get(edges, p).cast("double"), F.coalesce(F.get(edges, p + 1), F.get(edges, p)).cast("double")
        share = F.floor((F.col("key").cast("double") - lo) / (hi - lo + 1) * fine)
        return p.cast("long") * fine + F.greatest(F.least(share, F.lit(fine - 1)), F.lit(0)).cast("long")

    return let(at, cut)


def with_following(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``doc_id``, ``text`` and ``fingerprint``, and ``following`` and ``next_fingerprint``: those of the next smaller ``doc_id``, for the smallest
    those of the greatest. Every text is shuffled once and its tree is made once.

    Where rows share an id, the least of their texts stands for it and all of them are followed
    alike. A row without an id is followed by the empty text. NULL text counts as empty.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.where("key IS NOT NULL")
    rows = rows.withColumn("slice", _slice(rows, slice_rows))
    # the greatest id of a slice, with its text, comes before the next slice; that of the last one before the first
    ends = pin(rows.groupBy("slice").agg(F.max("key").alias("key")))  # a row per slice
    first = ends.agg(F.min("slice")).first()[0]
    chain = ends.select("slice", F.coalesce(F.lead("slice").over(Window.orderBy("slice")), F.lit(first).cast("long")).alias("to"))
    borders = rows.join(small_side(ends), ["slice", "key"]).groupBy("slice").agg(F.min("text").alias("text"))
    ghosts = borders.join(small_side(chain), "slice").select(F.lit(None).cast("long").alias("key"), "text", F.col("to").alias("slice"))
    dealt = rows.unionByName(ghosts).repartition("slice").withColumn("fingerprint", fingerprint(F.col("text")))
    in_order = Window.partitionBy("slice").orderBy(F.col("key").asc_nulls_first(), "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.struct("text", "fingerprint")
    dealt = dealt.withColumn("first", F.lag("key").over(in_order).isNull() | (F.lag("key").over(in_order) != F.col("key")))
    # the row that stands for the id before: what the last first row was, seen from the first row of an id
    dealt = dealt.withColumn("_last", F.last(F.when(F.col("first"), own), ignorenulls=True).over(so_far))
    dealt = dealt.withColumn("_before", F.when(F.col("first"), F.lag("_last").over(in_order)))
    dealt = dealt.withColumn("_next", F.last("_before", ignorenulls=True).over(so_far)).where("key IS NOT NULL")
    found = dealt.select(F.col("key").alias("doc_id"), "text", "fingerprint", F.col("_next.text").alias("following"), F.col("_next.fingerprint").alias("next_fingerprint"))
    # rows without an id are no key, and take no part in the shuffle
    alone = texts.where("key IS NULL").select(
        F.col("key").alias("doc_id"), "text", fingerprint(F.col("text")).alias("fingerprint"), F.lit("").alias("following"),
        fingerprint(F.lit("")).alias("next_fingerprint"))
    return found.unionByName(alone)


def compared_with_next(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each text's tree next to those of an edited text (its second half overwritten by the start
    of the following document) and of the following document, and how many paragraphs of the edited text are new. Texts of any
    length are hashed whole; an empty table gives no rows."""
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 2 as int))"),
                      F.expr("substring(following, 1, cast(length(text) div 2 as int))"))
    trees = with_following(docs, slice_rows).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    trees = trees.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return trees.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        n_edited(F.col("fingerprint"), F.col("edited_fingerprint")).alias("n_edited"))
