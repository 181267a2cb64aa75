"""Severity of toxic language by cumulative-link ordinal regression.

Grades 0 < 1 < 2 have ordered thresholds t1 < t2 and share one weight per feature:
P(grade >= k) = 1 / (1 + exp(t_k - w . x)), x = which words and beginnings of words of a
vocabulary a document has. The expected
severity is P(grade >= 1) + P(grade >= 2). Labels only say toxic or not; a document labelled toxic
is of grade 2 when it has more words that mark toxic documents than the median one, else of grade 1.

The classifier is fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of their ids,
with at most ``VOCABULARY`` words; both bounds are parameters. Scoring is one pass over all
documents without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.common import column, id_and_text, map_slices
from huntlake.session import pin

SAMPLE = 20_000
VOCABULARY = 5_000
#: Documents of the sample that a word must be in.
MIN_DOCUMENTS = 8
#: Standard errors by which a word's shares in toxic and other documents must differ to be a feature;
#: those more frequent in toxic documents mark them. Chance and wrong labels stay below.
MARKER = 4.5
HEADS = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct runs of letters in lower case."""
    found = set(text.lower().split())
    odd = [w for w in found if not w.isalpha()]
    found.difference_update(odd)
    for w in odd:
        found.update(LETTERS.findall(w))
    return found


def features_of(text: str) -> set[str]:
    """Words, and the heads of longer ones with a dash: inflected forms share a head."""
    words = words_of(text)
    found = set(words)
    for k in HEADS:
        found.update([w[:k] + "-" for w in words if len(w) > k])
    return found


@dataclass
class Ordinal:
    weights: dict[str, float]
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each score and k = 1, 2."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_words: int,
                ridge: float = 0.2, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient ascent (Adam) on the penalised likelihood. ``rows`` and
    ``cols`` are the places of the ones in the document by word matrix. Thresholds are kept in order
    by fitting the first and the logarithm of the step to the second."""
    n = max(1, len(grades))
    shares = np.clip([(grades >= k).mean() if len(grades) else 0 for k in (1, 2)], 1 / (4 * n), 1 - 1 / (4 * n))
    first, second = (np.log(1 / s - 1) for s in shares)
    p = np.r_[np.zeros(n_words), first, np.log(max(second - first, 1e-2))]
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        t1, gap = p[-2], np.exp(p[-1])
        score = np.bincount(rows, p[cols], len(grades))
        c1, c2 = (1 / (1 + np.exp(np.clip(t - score, -50, 50))) for t in (t1, t1 + gap))  # P(>=1), P(>=2)
        d1, d2 = c1 * (1 - c1), c2 * (1 - c2)
        like = np.maximum(np.choose(grades, [1 - c1, c1 - c2, c2]), 1e-12)
        by1 = np.choose(grades, [d1, -d1, 0 * d1]) / like   # by t1 alone
        by2 = np.choose(grades, [0 * d2, d2, -d2]) / like   # by t2 alone
        by_score = -(by1 + by2)
        g = np.r_[np.bincount(cols, by_score[rows], n_words), (by1 + by2).sum(), by2.sum() * gap] / n
        g[:n_words] -= ridge / n * p[:n_words]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        p = p + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return p[:n_words], np.array([p[-2], p[-2] + np.exp(p[-1])])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Ordinal:
    """Needs ``doc_id``, ``text`` of ``docs`` and ``doc_id``, ``toxic`` of ``labels``. Labels
    without id or value are left out; of several for one document the greatest counts. Without
    toxic labels nothing is found toxic."""
    chosen = (
        labels.select(column(labels, "doc_id").cast("long").alias("doc_id"), column(labels, "toxic").cast("int").alias("toxic"))
        .dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # broadcast: at most `sample` rows of two numbers
    marked = pin(id_and_text(docs).join(F.broadcast(chosen), "doc_id").limit(sample).select("toxic", "text"))

    def split():
        return lambda rows: {"toxic": rows.column("toxic"), "words": [sorted(features_of(t)) for t in rows.column("text").to_pylist()]}

    seen = map_slices(marked, split, "toxic int, words array<string>")
    n, n1 = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n0 = n - n1
    if not n1 or not n0:
        return Ordinal({}, np.array([50.0, 50.0]) if not n1 else np.array([-50.0, 50.0]))
    share = F.col("with_word") / n
    z = (F.col("toxic_with") / n1 - (F.col("with_word") - F.col("toxic_with")) / n0) / F.sqrt(
        share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    top = (
        seen.select("toxic", F.explode("words").alias("word")).groupBy("word")
        .agg(F.count(F.lit(1)).alias("with_word"), F.sum("toxic").alias("toxic_with"))
        .where(F.col("with_word") >= MIN_DOCUMENTS).select("word", z.alias("z"))
        .where(F.abs("z") >= MARKER).orderBy(F.abs("z").desc(), "word").limit(vocabulary).collect()
    )
    place = {r.word: i for i, r in enumerate(top)}
    markers = {i for i, r in enumerate(top) if r.z > 0}

    def numbered():
        return lambda rows: {"toxic": rows.column("toxic"), "places": [
            [place[w] for w in sorted(features_of(t) & place.keys())] for t in rows.column("text").to_pylist()]}

    data = map_slices(marked, numbered, "toxic int, places array<int>").toArrow()
    places = data.column("places").combine_chunks()
    cols = places.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(places)), places.value_lengths().to_numpy())
    toxic = data.column("toxic").to_numpy()
    marks = np.bincount(rows, np.isin(cols, sorted(markers)), len(toxic))
    median = np.median(marks[(toxic > 0) & (marks > 0)]) if ((toxic > 0) & (marks > 0)).any() else 0
    grades = np.where(toxic > 0, 1 + (marks > median), 0)
    weights, thresholds = fit_ordinal(rows, cols, grades, len(place))
    return Ordinal({w: float(weights[i]) for w, i in place.items()}, thresholds)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, expected ``severity`` (0 to 2), ``grade`` (the most probable
    one) and ``toxic`` (a grade above 0 is more likely than not).

    NULL text counts as empty and gets what a document without any known word gets. Repeated rows
    and equal ids give one result each, an empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # bounded by the vocabulary

    def make():
        own = Ordinal(*shared.value)
        weight, known = own.weights, own.weights.keys()

        def step(rows):
            scores = np.array([sum(weight[w] for w in sorted(known & features_of(t))) for t in rows.column("text").to_pylist()], float)
            p = own.at_least(scores)
            grade = np.argmax(np.c_[1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]], axis=1).astype(np.int32)
            return {"doc_id": rows.column("doc_id"), "severity": p.sum(axis=1), "grade": grade, "toxic": p[:, 0] > 0.5}

        return step

    return map_slices(id_and_text(docs), make, "doc_id long, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``docs`` without the rows that ``score`` would call toxic; columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        own = Ordinal(*shared.value)
        weight, known = own.weights, own.weights.keys()
        for batch in batches:
            scores = np.array([sum(weight[w] for w in sorted(known & features_of(t or ""))) for t in batch.column(at).to_pylist()], float)
            yield batch.filter(pa.array(own.at_least(scores)[:, 0] <= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
