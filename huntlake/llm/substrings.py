"""Removal of passages of 20 words that occur earlier, found by difference-cover anchors.

Positions modulo 13 that lie in {0, 1, 3, 9} form a difference cover: for any two positions there is
a shift below 13 that moves both into it. Two equal windows of 20 words therefore hold, at the same
shift, two equal windows of 20 - 12 = 8 words that both start at cover positions. Only those short
windows, 4 of 13, are hashed and compared between slices. Where one occurs twice, it is extended: the
windows of 20 words around it are hashed, and of equal ones all but the earliest are removed. No
pairs of documents are formed, so a passage that millions share costs one key per slice.

Documents with equal words are searched once: of those, all but the first are removed whole.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.common import id_and_text
from huntlake.llm.exchange import (
    BLOCK, answers, block_batch, blocks, bucket_count, grouped, make_slices, per_document, read_answers, store, unpack,
)
from huntlake.llm.words import WordHashes, digest, runs

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Sorts after every id; stands for a missing one.
LAST_ID = (1 << 63) - 1


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _describe():
    """``n``: windows of a text; ``name``: hash of its sequence of words."""
    hashes = WordHashes(lower=False)

    def step(texts):
        texts = [t.encode() for t in texts]
        h, at = hashes.many(texts)
        n = np.diff(at)
        return {
            "n": np.maximum(n - WINDOW + 1, 0).tolist(), "words": n.tolist(),
            "name": [digest(h[i:j]) for i, j in zip(at[:-1], at[1:])], "whole": [_sha(t.split()) for t in texts],
        }

    return step


class _Slice:
    """The texts of a slice that are the first of their words, and the hashes of their windows.
    Positions count words over all these texts."""

    def __init__(self, row: dict, hashes: WordHashes):
        first = {x["name"]: x["doc_id"] for x in row["own"]}
        held = [x for x in unpack(row) if x[0] in first]
        self.id, self.texts = row["slice"], [text for _, text in held]
        self.names = np.array([name for name, _ in held], np.int64)
        self.docs = np.array([first[name] for name, _ in held], np.int64)
        self.hashed, self.start = hashes.many(self.texts)
        self.text = np.repeat(np.arange(len(held)), np.diff(self.start))
        self.place = np.arange(len(self.hashed)) - self.start[self.text]
        self.left = self.start[self.text + 1] - np.arange(len(self.hashed))  # words from here to the end

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Key and position of the short windows at cover positions."""
        cover = np.isin(np.arange(PERIOD), COVER)
        at = np.flatnonzero(cover[self.place % PERIOD] & (self.left >= ANCHOR))
        return runs(self.hashed, ANCHOR)[at], at

    def windows(self, row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Key and start of the long windows that hold a repeated short one at a shift below the
        period."""
        key, at = self.anchors()
        known, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at = at[((count > 1) | read_answers(known, row["anchors"], buckets)[0])[inverse]]
        low = np.maximum(at - (PERIOD - 1), self.start[self.text[at]])
        n = len(self.hashed)
        edge = np.bincount(low, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
        starts = np.flatnonzero((np.cumsum(edge[:n]) > 0) & (self.left >= WINDOW))
        return runs(self.hashed, WINDOW)[starts], starts


def _anchor_requests(work: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes(lower=False)
        for batch in batches:
            for i in range(batch.num_rows):
                s = _Slice(batch.slice(i, 1).to_pylist()[0], hashes)
                key, count = np.unique(s.anchors()[0], return_counts=True)
                same = np.full(len(key), s.id, np.int64)
                yield block_batch(blocks(s.id, key, same, np.zeros_like(same), count > 1, buckets))

    return work.mapInArrow(run, BLOCK)


def _window_requests(work: DataFrame, anchor_buckets: int, buckets: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes(lower=False)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                s = _Slice(row, hashes)
                key, at = s.windows(row, anchor_buckets)
                key, doc, name, several, _ = grouped(key, s.docs[s.text[at]], s.names[s.text[at]])
                yield block_batch(blocks(s.id, key, doc, name, several, buckets))

    return work.mapInArrow(run, BLOCK)


def _cut(work: DataFrame, anchor_buckets: int, buckets: int) -> DataFrame:
    """(seq, n_removed, kept) for the searched texts that lose words."""
    def run(batches):
        hashes = WordHashes(lower=False)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                s = _Slice(row, hashes)
                key, at = s.windows(row, anchor_buckets)
                doc, name = s.docs[s.text[at]], s.names[s.text[at]]
                known, least, tie, _, _ = grouped(key, doc, name)
                yes, other, other_tie = read_answers(known, row["windows"], buckets)
                least, tie = np.where(yes, other, least), np.where(yes, other_tie, tie)
                order = np.lexsort((at, name, doc, key))
                key, doc, name, at = key[order], doc[order], name[order], at[order]
                of = np.searchsorted(known, key)
                stays = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
                stays &= (doc == least[of]) & (name == tie[of])
                at, n = at[~stays], len(s.hashed)
                gone = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + WINDOW, minlength=n + 1))[:n] > 0
                out = {"seq": [], "n_removed": [], "kept": []}
                for t in np.unique(s.text[at]).tolist():
                    lost = gone[s.start[t]:s.start[t + 1]]
                    out["seq"].append(int(s.names[t]))
                    out["n_removed"].append(int(lost.sum()))
                    out["kept"].append(b" ".join(compress(s.texts[t].split(), (~lost).tolist())).decode())
                yield pa.RecordBatch.from_pydict({
                    "seq": pa.array(out["seq"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()),
                    "kept": pa.array(out["kept"], pa.string())})

    return work.mapInArrow(run, "seq long, n_removed long, kept string")


def without_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two frames: per row of ``docs`` ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256``; and
    the texts left of sequences of words that lose some but are not removed whole (``seq``, ``kept``).

    Earlier means a smaller id, or the same document and an earlier start. NULL ids sort last.
    Rows that share an id and have equal words are one document; with other words they follow each
    other in a fixed order. NULL text has no words. Nothing is removed from texts of fewer than 20
    words. An empty table gives no rows; other columns are ignored.
    """
    rows = id_and_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    slices = make_slices(rows, _describe, ", words array<long>, whole array<binary>")
    counted = per_document(slices, "doc_id", "n", "name", "words", "whole")
    first = counted.where("n > 0").groupBy("name").agg(
        F.min(F.struct("doc_id", "slice")).alias("at"), F.min("n").alias("n"))
    first = store(first.select("name", F.col("at.slice").alias("slice"), F.col("at.doc_id").alias("first_id"), "n"), "first")
    total = first.agg(F.sum("n")).first()[0] or 0
    own = first.groupBy("slice").agg(F.collect_list(F.struct("name", F.col("first_id").alias("doc_id"))).alias("own"))
    work = slices.select("slice", "packed", "sizes", "body").join(own, "slice")

    few, many = bucket_count(docs, total * len(COVER) // PERIOD), bucket_count(docs, total)
    anchors = store(answers(_anchor_requests(work, few)), "anchors").withColumnRenamed("answers", "anchors")
    work = work.join(anchors, "slice", "left")
    windows = store(answers(_window_requests(work, few, many)), "windows").withColumnRenamed("answers", "windows")
    cut = _cut(work.join(windows, "slice", "left"), few, many)

    digests = cut.select(F.col("seq").alias("name"), F.col("n_removed").alias("cut_words"), F.sha2("kept", 256).alias("cut_sha"))
    joined = counted.join(first.select("name", "first_id"), "name", "left").join(digests, "name", "left")
    copy = F.col("first_id").isNotNull() & (F.col("doc_id") > F.col("first_id"))
    out = joined.select(
        F.nullif("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.col("words").alias("n_words"),
        F.when(copy, F.col("words")).otherwise(F.coalesce("cut_words", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", F.lower(F.hex("whole")))).alias("kept_sha256"))
    return out, cut.select("seq", "kept")
