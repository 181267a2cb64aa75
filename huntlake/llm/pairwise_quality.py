"""Text quality by Bradley-Terry ranking of preference pairs.

A document has a strength w . x; it is preferred to another with probability 1 / (1 + exp(-(w . x - w . y))). Pairs are of a
document labelled good and one labelled bad, so w is fitted by logistic loss on differences of features. Features are shares:
of kinds of characters and of their successions, of words and lines that differ, of neighbours that are equal, taken over whole
texts in segments, and lengths. They know no vocabulary, language, source or id.

All documents are scored; the quantile of all scores at which labels are told apart best is the threshold, and strengths become
scores by a logistic curve that is 0.7 there.

Fitted on at most ``PER_LABEL`` labelled documents of each label, chosen by a hash of their ids, with ``PAIRS`` pairs for each;
both are parameters. The choice of the quantile sees all labelled documents that are not held out.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.llm.common import column, map_slices
from huntlake.llm.exchange import store

PER_LABEL, PAIRS = 10_000, 8
#: Quantiles that may become the threshold, and the score there.
LEVELS, AT_THRESHOLD = 2_000, 0.7
SEGMENT = 1 << 16
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".,", "!?", ":;-'", "\"()[]{}", "|", "#*$%&<>", "@/\\_=+~^`")
_KIND = np.full(256, len(_KINDS), np.uint8)  # control characters
for _i, _letters in enumerate(_KINDS):
    _KIND[list(_letters.encode())] = _i
_KIND[128:] = len(_KINDS) + 1
N_KINDS = len(_KINDS) + 2
N_SHARES = 6
WIDTH = N_SHARES + 3 + N_KINDS + N_KINDS * N_KINDS


def _segments(text: bytes):
    at = 0
    while at < len(text):
        end = at + SEGMENT
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


def features(text: bytes) -> np.ndarray:
    """What a text looks like. Words and lines are compared inside segments of ``SEGMENT`` bytes, so memory is bounded for any
    length; the shares of segments are averaged by their words."""
    moves, shares, n_words, n_lines = np.zeros(N_KINDS * N_KINDS), np.zeros(N_SHARES), 0, 0
    kinds = np.zeros(N_KINDS)
    for piece in _segments(text):
        kind = _KIND[np.frombuffer(piece, np.uint8)].astype(np.intp)
        kinds += np.bincount(kind, minlength=N_KINDS)
        moves += np.bincount(kind[:-1] * N_KINDS + kind[1:], minlength=N_KINDS * N_KINDS)
        words = piece.split()
        if not words:
            continue
        n, lines = len(words), [x for x in piece.split(b"\n") if x]
        distinct = len(set(words))
        shares += n * np.array([
            distinct / n, np.log1p(distinct) / np.log1p(n), sum(map(operator.eq, words, words[1:])) / n,
            sum(map(operator.eq, words, words[2:])) / n, len(set(lines)) / max(len(lines), 1), len(set(zip(words, words[1:]))) / n,
        ])
        n_words += n
        n_lines += len(lines)
    size = max(kinds.sum(), 1)
    return np.r_[shares / max(n_words, 1), np.log1p(n_words), np.log1p(size / max(n_words, 1)), np.log1p(n_words / max(n_lines, 1)),
                 np.sqrt(kinds / size), np.sqrt(moves / size)].astype(np.float32)


def fit_pairs(better: np.ndarray, worse: np.ndarray, pairs: int = PAIRS, ridge: float = 1.0, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights of the Bradley-Terry model, where each row of ``better`` is preferred to ``pairs`` rows of ``worse`` and the other way
    round, by gradient descent (Adam) on the logistic loss of the feature differences."""
    x, n1, n0 = np.vstack([better, worse]), len(better), len(worse)
    turn = np.arange(1, pairs + 1) * 7919
    win = np.r_[np.repeat(np.arange(n1), pairs), ((np.arange(n0)[:, None] * 31 + turn) % n1).ravel()]
    lose = n1 + np.r_[((np.arange(n1)[:, None] * 31 + turn) % n0).ravel(), np.repeat(np.arange(n0), pairs)]
    w, mean, square = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, steps + 1):
        s = x @ w
        miss = -1 / (1 + np.exp(np.clip(s[win] - s[lose], -50, 50)))  # slope of the loss by the difference
        g = (np.bincount(win, miss, len(s)) - np.bincount(lose, miss, len(s))) @ x / len(win) + ridge / len(win) * w
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w = w - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return w


@dataclass
class Ranking:
    """Strength of a document: ``weights`` . (features - ``middle``) / ``spread``, features no further than 8 spreads off."""

    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.spread, -8, 8)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``good`` of the labels to learn from. Ids labelled both ways, or without a label, are left out."""
    rows = labels.select(column(labels, "doc_id").cast("long").alias("doc_id"), column(labels, "quality").cast("int").alias("good")).dropna()
    return rows.where(~held_out(F.col("doc_id")) & F.col("good").isin(0, 1)).groupBy("doc_id").agg(
        F.min("good").alias("good"), F.max("good").alias("most")).where("good = most").drop("most")


def fit(docs: DataFrame, known: DataFrame, per_label: int = PER_LABEL, pairs: int = PAIRS) -> Ranking | None:
    """``known`` as from ``known_labels``. None without labels of both kinds. Of rows with one id, the one with the least features counts."""
    some = [known.where(F.col("good") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    # broadcast: two numbers for at most 2 * per_label ids
    chosen = _texts(docs).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")

    def look():
        return lambda rows: {"doc_id": rows.column("doc_id"), "good": rows.column("good"),
                             "x": [features(t).tobytes() for t in rows.column("text").to_pylist()]}

    rows = map_slices(chosen, look, "doc_id long, good int, x binary").groupBy("doc_id", "good").agg(F.min("x").alias("x"))
    found = rows.orderBy("doc_id").toArrow()  # bounded by the sample: a few hundred numbers for each id
    good = found.column("good").to_numpy()
    if not 0 < good.sum() < len(good):
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
    ranking = Ranking(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), np.zeros(WIDTH))
    scaled = ranking.scaled(x)
    ranking.weights = fit_pairs(scaled[good == 1], scaled[good == 0], pairs)
    return ranking


def strengths(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``doc_id``, ``strength`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)  # a few hundred numbers

    def make():
        own = shared.value

        def step(rows):
            texts = rows.column("text").to_pylist()
            x = np.array([features(t) for t in texts], np.float32).reshape(-1, WIDTH)
            return {"doc_id": rows.column("doc_id"), "strength": own.strength(x)}

        return step

    return map_slices(_texts(docs), make, "doc_id long, strength double")


def best_level(good: np.ndarray, bad: np.ndarray) -> int:
    """Of the cuts before each bin (counts of good and bad in order of strength), the middle one of those that put most on their side."""
    right = np.r_[0, np.cumsum(bad)] + good.sum() - np.r_[0, np.cumsum(good)]
    best = np.flatnonzero(right == right.max())
    return int(best[len(best) // 2])


def slope(x: np.ndarray, good: np.ndarray, bad: np.ndarray, offset: float) -> float:
    """The steepness of a logistic curve through (0, ``offset``) under which the counts at ``x`` are most likely."""
    grid = np.geomspace(1e-3, 1e3, 121) / max(np.abs(x).max(), 1e-9)
    z = offset + grid[:, None] * x[None, :]
    return float(grid[np.argmin(np.logaddexp(0, -z) @ good + np.logaddexp(0, z) @ bad)])


def quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, pairs: int = PAIRS, levels: int = LEVELS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``AT_THRESHOLD`` on) per row of ``docs``.

    NULL text is empty, an empty text has the score of its features like any other; very long texts are read in segments; rows without
    an id are scored and not held out; repeated rows and ids give one result each; an empty table gives no rows; without labels of both
    kinds every score is ``AT_THRESHOLD``. Other columns are ignored.
    """
    known = known_labels(labels)
    ranking = fit(docs, known, per_label, pairs)
    held = held_out(F.col("doc_id")).alias("held_out")
    if ranking is None:
        return _texts(docs).select("doc_id", held, F.lit(AT_THRESHOLD).alias("score"), F.lit(1).alias("predicted"))
    found = store(strengths(docs, ranking), "quality-strengths")
    marks = found.agg(F.percentile_approx("strength", [i / levels for i in range(levels + 1)], 20 * levels)).first()[0]
    marks = np.unique(marks)
    good, bad = _binned(found.join(known, "doc_id").select("strength", "good"), marks)
    threshold = float(marks[min(max(best_level(good, bad) - 1, 0), len(marks) - 1)])
    offset = float(np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)))
    centre = np.r_[marks[0], marks] - threshold
    steep = min(slope(centre, good, bad, offset), 30 / max(np.abs(centre).max(), 1e-9))
    score = 1 / (1 + F.exp(-(F.lit(offset) + F.lit(steep) * (F.col("strength") - F.lit(threshold)))))
    return found.select("doc_id", held, score.alias("score")).withColumn("predicted", (F.col("score") >= AT_THRESHOLD).cast("int"))


def _binned(rows: DataFrame, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many good and bad rows lie between neighbouring marks."""
    def make():
        def step(part):
            at = np.searchsorted(marks, part.column("strength").to_numpy(), "right")
            good = part.column("good").to_numpy()
            both = np.bincount(at * 2 + good, minlength=2 * len(marks) + 2)
            kept = np.flatnonzero(both)
            return {"bin": kept, "n": both[kept]}

        return step

    found = map_slices(rows, make, "bin long, n long", "strength").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * len(marks) + 2)
    for r in found:
        out[r.bin] = r.n
    return out[1::2], out[::2]
