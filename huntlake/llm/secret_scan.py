"""Secret scan with a random forest that removes false positives; DataFrame functions and MLlib only.

Candidates are long unbroken strings with a digit. Each is described by its length, the transitions
between kinds of characters in it, how much of it dictionary words cover, whether it is part of a
path, and the words next to it. A forest trained on labelled findings gives the probability that it
is a secret. Where no findings were labelled by people, ``labelled_by_rule`` marks the clear cases
and the forest decides the others.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.llm.common import id_and_text
from huntlake.llm.sanitise import located
from huntlake.session import pin

#: A word of the dictionary is in two documents or more, and in one of so many.
DICTIONARY = 10_000
CONTEXT = 48
THRESHOLD = 0.5
CANDIDATE = r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=.-]{0,199}[0-9])[A-Za-z0-9+/_=.-]{16,200}(?![A-Za-z0-9+/_=.-])"
#: Names that announce a secret, and those that announce something else.
NAMING = r"(?i)\b(?:api[_-]?key|access[_-]?key|auth|bearer|credential|passwd|password|private[_-]?key|pwd|secret|token)s?\b"
OTHER = r"(?i)\b(?:checksum|commit|digest|hash|id|isbn|md5|revision|serial|sha1|sha256|uuid|version)\b"
FEATURES = ("size", "distinct", "digits", "uppers", "kind_changes", "sound_changes", "hex_only", "covered",
            "slashes", "dots", "in_path", "named", "named_other", "assigned", "quoted", "words_before", "words_after")


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``stop`` (code points), ``value``, ``before`` and ``after`` per candidate."""
    rows = id_and_text(docs).where(F.col("text").rlike(r"[0-9]") & F.col("text").rlike(CANDIDATE))
    found = rows.select("doc_id", "text", F.explode(located(F.col("text"), CANDIDATE)).alias("s"))
    return found.select(
        "doc_id", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"), F.col("s.value").alias("value"),
        F.expr(f"substring(text, greatest(1, s.start + 1 - {CONTEXT}), least({CONTEXT}, s.start))").alias("before"),
        F.expr(f"substring(text, s.stop + 1, {CONTEXT})").alias("after"))


def dictionary(docs: DataFrame, one_of: int = DICTIONARY) -> DataFrame:
    """``word``: those of three letters or more that two documents or more, and at least one document of ``one_of``, have."""
    rows = id_and_text(docs)
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?<!\p{L})\p{L}{3,24}+(?!\p{L})"), F.lit(0))
    counted = rows.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") > 1) & (F.col("n") * one_of >= rows.count())).select("word")


def _covered(found: DataFrame, known: DataFrame) -> DataFrame:
    """``value`` and how many of its letters are in words that ``known`` has."""
    parts = found.select("value").distinct().select("value", F.explode(F.split(F.lower("value"), r"[^\p{L}]+")).alias("word"))
    return parts.join(known, "word").groupBy("value").agg(F.sum(F.length("word")).alias("letters"))


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with the features of each candidate; ``known`` has the dictionary's ``word``."""
    columns = found.columns
    found = found.join(_covered(found, known), "value", "left").select(*columns, "letters")
    v, n = F.col("value"), F.length("value")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    covered = F.coalesce("letters", F.lit(0)) / n
    near = F.regexp_extract(F.col("before"), r"([^\n]{0,32})$", 1)
    flag = lambda c: c.cast("double")
    return found.withColumns({
        "size": n.cast("double"), "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"),
        "kind_changes": share("(?<=[0-9])[^0-9]|(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[^A-Za-z0-9])[A-Za-z0-9]"),
        "sound_changes": share("(?i)(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]"),
        "hex_only": flag(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "covered": covered,
        "slashes": share("/"), "dots": share(r"\."), "in_path": flag(v.rlike(r"[A-Za-z0-9_-]/[A-Za-z0-9_-]") | near.rlike(r"(?:[/\\]|https?:\S*)$")),
        "named": flag(near.rlike(NAMING)), "named_other": flag(near.rlike(OTHER)),
        "assigned": flag(near.rlike(r"(?:[:=]|=>)\s*[\"'`]?$")),
        "quoted": flag(near.rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "words_before": F.regexp_count(F.col("before"), F.lit(r"\p{L}+")).cast("double"),
        "words_after": F.regexp_count(F.col("after"), F.lit(r"\p{L}+")).cast("double"),
    }).drop("letters")


def labelled_by_rule(found: DataFrame) -> DataFrame:
    """``label`` 1 for varied strings assigned to a secret's name, 0 for numbers, paths, strings made of
    words and values of other names; what neither rule is sure of has no label and is left out."""
    good = (F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("distinct") * F.col("size") >= 8) & (F.col("covered") < 0.5)
    bad = (F.col("digits") == 1) | (F.col("in_path") == 1) | (F.col("covered") >= 0.5) | (
        (F.col("named") == 0) & ((F.col("named_other") == 1) | (F.col("assigned") == 0)))
    return found.withColumn("label", F.when(good, 1.0).when(bad, 0.0)).where("label is not null")


def fit(labelled: DataFrame, trees: int = 30, depth: int = 6):
    """A forest from all rows with ``label`` (0 or 1), the features, ``value`` and ``before``, in a fixed order; None without findings
    of both kinds."""
    rows = pin(labelled.repartition("value", "before").sortWithinPartitions("value", "before", "label", *FEATURES).select("label", *FEATURES))
    if rows.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(data)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row per candidate: ``doc_id``, ``start``, ``stop``, ``value_sha256``, ``probability``, ``kept``
    (not a false positive).

    ``labelled`` holds findings with ``label``, ``value``, ``before`` and ``after``; without it the
    rules label the candidates at hand. NULL or empty texts have no candidates; an empty table gives
    no rows; repeated rows and equal ids give one result each; other columns are ignored. A very long
    string without a break is no candidate beyond 200 characters. Without labelled findings of both
    kinds the probability is 1 for strings assigned to a secret's name, else 0.
    """
    known = pin(dictionary(docs))
    found = pin(described(candidates(docs), known))
    model = fit(labelled_by_rule(found) if labelled is None else described(labelled, known))
    if model is None:
        scored = found.withColumn("probability", F.col("named") * F.col("assigned"))
    else:
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(found)
        model.setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction")
        scored = model.transform(data).withColumn("probability", F.round(vector_to_array("_probability")[1], 6))
    return scored.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
                         F.sha2("value", 256).alias("value_sha256"), "probability", (F.col("probability") >= threshold).alias("kept"))
