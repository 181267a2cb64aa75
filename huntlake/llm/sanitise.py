"""Personal data and the terms that give it away, in DataFrame functions only.

Patterns find the protected entities (addresses, numbers). What a reader could still infer from the
words around them is estimated from the corpus: a term that occurs near an entity discloses it as
far as the pointwise mutual information of the two reaches the information content of the entity,

    PMI(e, t) = log2(N * n(e, t) / (n(e) * n(t)))        IC(e) = log2(N / n(e))

with document counts n over all documents. The ratio PMI / IC is 1 when the term occurs only where
the entity does. Terms from ``GENERALISE`` on are replaced by a class name, from ``REMOVE`` on they
are removed, in every document that holds the entity near the term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.functions.common import let
from huntlake.llm.common import column, fresh
from huntlake.plans.sizes import small_side
from huntlake.session import pin

KINDS = ("email", "ip", "card", "phone", "term", "drop")
#: Characters on either side of an entity that count as near it.
NEAR = 200
#: Different texts in which a term must be near an entity before it can be judged.
SUPPORT = 3
GENERALISE, REMOVE = 0.90, 0.97
#: Terms are runs of 3 to 40 letters; most terms whose counts may be joined by broadcast.
TERM = r"(?<!\p{L})\p{L}{3,40}+(?!\p{L})"
BROADCAST_TERMS = 200_000

# A group that repeats is possessive: nothing follows it, so the matches are the same, and Java
# then loops instead of recursing. A run is tried at its first character only, or where the last
# match ended; a later start in it would fail alike.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"


def running_totals(lengths: Column) -> Column:
    """For each entry the sum of those before it. In pieces of 64, since each step of a plain
    aggregation over an array would copy what it has so far."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def places(ls: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(ls) - 1).bitwiseAND(-64), F.lit(64)),
                             lambda b: total(F.slice(ls, b + 1, 64)))
        heads = F.aggregate(
            blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
            lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
        return let(heads, lambda h: F.transform(ls, lambda _, i: F.get(h, F.shiftright(i, 6)) + total(
            F.slice(ls, i.bitwiseAND(-64) + 1, i.bitwiseAND(63)))))

    return let(lengths, lambda ls: F.when(F.size(ls) == 0, F.array().cast("array<int>")).otherwise(places(ls)))


def located(text: Column, pattern: str) -> Column:
    """Every match of ``pattern``: array of (start, stop, value), code points, stop exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        hit, gap = both["hits"], both["gaps"]
        sizes = F.transform(hit, lambda h, i: F.length(h) + F.length(F.get(gap, i)))
        return let(running_totals(sizes), lambda before: F.transform(hit, lambda h, i: let(
            F.get(before, i) + F.length(F.get(gap, i)),
            lambda at: F.struct(at.alias("start"), (at + F.length(h)).alias("stop"), h.alias("value")))))

    return let(F.struct(hits.alias("hits"), gaps.alias("gaps")), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def doubled(d: Column, i: Column) -> Column:
        two = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(two > 9, two - 9).otherwise(two))

    def total(digits: Column) -> Column:
        figures = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: doubled(c.cast("int"), i))
        return F.aggregate(figures, F.lit(0), lambda s, x: s + x) % 10 == 0

    return let(_digits(value), lambda d: F.length(d).between(14, 19) & total(d))


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        return let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) <= 3) & (F.coalesce(F.nullif(p, F.lit("")), F.lit("0")).try_cast("int") <= 255))
    return F.forall(F.split(value, r"\."), small)


def base_spans(text: Column) -> Column:
    """Array of (start, kind, stop, value) in order of start and then kind (its place in KINDS)."""
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")
    rules = (
        (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), _octets),
        (CARD, text.rlike(r"[0-9](?:[ -]?[0-9]){13}"), _luhn),
        (PHONE, text.rlike(r"\+[0-9]"), lambda v: F.length(_digits(v)).between(10, 15)),
    )

    def part(kind: int, pattern: str, possible: Column, valid) -> Column:
        good = F.filter(located(text, pattern), lambda s: valid(s["value"]))
        shaped = F.transform(good, lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))
        return F.when(possible, shaped).otherwise(none)

    return F.array_sort(F.concat(*[part(kind, *rule) for kind, rule in enumerate(rules)]))


def printed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """``doc_id``, ``generalise`` and ``remove`` (arrays of terms in lower case) for the documents
    that hold an entity near a term which gives it away. Needs ``doc_id`` (long) and ``text``."""
    held = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", base_spans(F.col("text")).alias("spans"))
    entity = F.when(F.col("s.kind") == 0, F.lower("s.value")).when(F.col("s.kind") == 1, F.col("s.value")).otherwise(
        F.concat(F.when(F.col("s.kind") == 3, F.lit("+")).otherwise(F.lit("")), _digits(F.col("s.value"))))
    around = F.concat_ws(
        " ", F.expr(f"substring(text, greatest(1, s.start + 1 - {NEAR}), least({NEAR}, s.start))"),
        F.expr(f"substring(text, s.stop + 1, {NEAR})"))
    near = (
        held.where(F.size("spans") > 0)
        .select("doc_id", F.xxhash64("text").alias("text_id"), "text", F.explode("spans").alias("s"))
        .select("doc_id", "text_id", entity.alias("entity"), F.explode(F.array_distinct(
            F.regexp_extract_all(F.lower(around), F.lit(TERM), F.lit(0)))).alias("term"))
        .distinct()
    )
    near = pin(near)
    pairs = near.groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_both"), F.count_distinct("text_id").alias("n_texts")).where(F.col("n_texts") >= support)
    terms = pairs.select("term").distinct()
    every = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    few = small_side(terms, BROADCAST_TERMS)  # at most that many strings of at most 40 letters
    if few is not terms:
        every = every.join(few, "term", "left_semi")
    n_term = every.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(terms, "term", "left_semi")
    n_entity = near.groupBy("entity").agg(F.count_distinct("doc_id").alias("n_entity"))
    n = docs.count()
    content = F.log2(F.lit(float(n)) / F.col("n_entity"))
    shared = F.log2(F.lit(float(n)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    judged = (
        pairs.join(n_term, "term").join(n_entity, "entity").where(content > 0)
        .select("entity", "term", (shared / content).alias("ratio")).where(F.col("ratio") >= threshold)
    )
    mine = near.join(judged, ["entity", "term"]).groupBy("doc_id", "term").agg(F.max("ratio").alias("ratio"))
    return mine.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("ratio") < REMOVE, F.col("term"))).alias("generalise"),
        F.collect_list(F.when(F.col("ratio") >= REMOVE, F.col("term"))).alias("remove"))


def _term_spans(text: Column, base: Column, generalise: Column, remove: Column) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>")
    words = F.filter(located(text, TERM), lambda w: F.array_contains(generalise, F.lower(w["value"])) | F.array_contains(remove, F.lower(w["value"])))
    free = F.filter(words, lambda w: ~F.exists(base, lambda b: (w["start"] < b["stop"]) & (b["start"] < w["stop"])))
    shaped = F.transform(free, lambda w: F.struct(
        w["start"].alias("start"), F.when(F.array_contains(remove, F.lower(w["value"])), F.lit(5)).otherwise(F.lit(4)).alias("kind"),
        w["stop"].alias("stop"), w["value"].alias("value")))
    return F.when(generalise.isNull(), none).otherwise(shaped)


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with spans replaced by the name of their kind in brackets, dropped terms by nothing.
    Of spans that overlap, what an earlier one already covers is not replaced again."""
    names = F.array(*[F.lit(f"[{k.upper()}]" if k != "drop" else "") for k in KINDS])

    def step(done: Column, s: Column) -> Column:
        kept = F.when(s["start"] >= done["at"], F.array(
            F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.get(names, s["kind"]))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), F.concat(done["parts"], kept).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = F.aggregate(spans, start, step, lambda d: F.concat(
        F.array_join(d["parts"], ""), F.substring(text, d["at"] + 1, F.lit((1 << 31) - 1) - d["at"] - 1)))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def find_personal(docs: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``text``, ``base`` (spans of the patterns) and ``spans``
    (those and the disclosing terms, in order).

    NULL text counts as empty and has no spans. A row without an id takes no part in the estimate
    and gets pattern spans only. Repeated rows and equal ids give one result each; an empty table
    gives no rows; other columns are ignored. Patterns cost linear time in the text.
    """
    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    found = rows.join(disclosing_terms(rows, support, threshold), "doc_id", "left")
    found = found.withColumn("base", base_spans(F.col("text")))
    terms = _term_spans(F.col("text"), F.col("base"), F.col("generalise"), F.col("remove"))
    return found.select("doc_id", "text", "base", F.array_sort(F.concat("base", terms)).alias("spans"))


def sanitised(docs: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """``docs`` with personal data and disclosing terms taken out of ``text``; columns and number of
    rows stay. A NULL text stays NULL."""
    ids = column(docs, "doc_id").cast("long")
    rows = docs.select(ids.alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    terms = disclosing_terms(rows, support, threshold)
    key, soft, hard, base = (fresh(docs, n) for n in ("_owner", "_soft", "_hard", "_base"))
    joined = docs.join(terms.select(F.col("doc_id").alias(key), F.col("generalise").alias(soft), F.col("remove").alias(hard)),
                       ids == F.col(key), "left")
    text = column(docs, "text")
    joined = joined.withColumn(base, base_spans(F.col("text")))
    spans = F.array_sort(F.concat(F.col(base), _term_spans(text, F.col(base), F.col(soft), F.col(hard))))
    clean = let(spans, lambda s: redacted(text, s))
    out = joined.withColumn("text", F.when(F.size(base) + F.size(F.coalesce(soft, F.array().cast("array<string>"))) + F.size(F.coalesce(hard, F.array().cast("array<string>"))) > 0, clean).otherwise(text))
    return out.drop(key, soft, hard, base)
