"""Quality rules with a suffix-array measure of repetition.

For a slice of documents at once, the suffixes of all word sequences are sorted by prefix doubling
(suffixes of different documents never compare equal). Common prefixes of neighbours in that order
bound the intervals of repeated substrings; the longest interval through a position gives the
longest passage starting there that occurs again in the document. The union of those passages and
the longest of them are limited. No shuffle: documents are judged where they are read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from huntlake.llm.common import id_and_text, map_slices

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Words from which a repeated passage counts for the method, the share of a document that such
#: passages may cover, and the longest that one may be.
MIN_PASSAGE = 20
MAX_COVERED = 0.30
MAX_PASSAGE = 200
SPACE = re.compile(r"[\x20\x09-\x0D]")


def suffix_levels(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order (within each document) and, for each k = 1, 2, 4, …, ranks that are equal
    exactly where the next k words are. ``doc`` ascends and ``words`` are ids from 0."""
    n = len(words)
    ids = np.arange(n)
    key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")

    def ranked(rows: np.ndarray, keys: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Rank of a row: place of the first of its group; ``rows`` are sorted by ``keys``."""
        head = np.r_[True, keys[1:] != keys[:-1]] if len(rows) else np.empty(0, bool)
        return base[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]

    rank = np.empty(n, np.int64)
    rank[order] = ranked(order, key[order], ids)
    levels, k = [rank.astype(np.int32)], 1
    while n:
        sizes = np.bincount(rank, minlength=n)
        open_rows = order[sizes[rank[order]] > 1]
        if not len(open_rows):
            break
        after = open_rows + k
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[open_rows[inside]]
        second = np.zeros(len(open_rows), np.int64)
        second[inside] = rank[after[inside]] + 1
        pair = rank[open_rows] * (n + 1) + second
        places = np.flatnonzero(sizes[rank[order]] > 1)
        by = np.argsort(pair, kind="stable")
        rows = open_rows[by]
        order[places] = rows
        rank[rows] = ranked(rows, pair[by], places)
        levels.append(rank.astype(np.int32))
        k *= 2
    return order, levels


def repeats(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position the length of the longest passage starting there that starts elsewhere in
    the same document as well (overlap allowed)."""
    n = len(words)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    order, levels = suffix_levels(words, doc)
    same = np.flatnonzero(doc[order[1:]] == doc[order[:-1]])
    a, b = order[same], order[same + 1]
    shared = np.zeros(len(same), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        i, j = a + shared, b + shared
        ok = np.maximum(i, j) < n
        ok[ok] = (rank[i[ok]] == rank[j[ok]]) & (doc[i[ok]] == doc[a[ok]]) & (doc[j[ok]] == doc[b[ok]])
        shared[ok] += 1 << level
    np.maximum.at(longest, a, shared)
    np.maximum.at(longest, b, shared)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Words of each document inside the union of the spans."""
    edge = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=docs)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if SPACE.sub("", x)] if "\n" in text else []
    return len(lines) - len(set(lines))


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """All counts of the rules for a list of texts."""
    ids: dict[bytes, int] = {}
    sizes, codes, chars, symbols, lines = [], [], [], [], []
    for t in texts:
        words = t.encode().split()
        sizes.append(len(words))
        codes.extend([ids.setdefault(w, len(ids)) for w in words])
        chars.append(len(t) - sum(map(t.count, " \t\n\v\f\r")))
        symbols.append(sum(map(t.count, "#*$%&|<>")))
        lines.append(duplicate_lines(t))
    doc = np.repeat(np.arange(len(texts)), sizes)
    run = repeats(np.array(codes, np.int64), doc)
    three, long = np.flatnonzero(run >= 3), np.flatnonzero(run >= MIN_PASSAGE)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, run)
    return {
        "n_words": np.array(sizes, np.int64), "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": covered(three, np.full(len(three), 3), doc, len(texts)),
        "covered_words": covered(long, run[long], doc, len(texts)), "longest_repeat": longest,
    }


def quality_rules(docs: DataFrame, max_covered: float = MAX_COVERED, max_passage: int = MAX_PASSAGE) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the counts, ``base_failed`` and ``kept``.

    ``kept`` is false where the base rules fail, where repeated passages of at least
    ``MIN_PASSAGE`` words cover more than ``max_covered`` of the words, or where one repeated
    passage has more than ``max_passage`` words. A NULL or empty text has no words and fails.
    Repeated rows and equal ids give one result each; an empty table gives no rows; other columns
    are ignored. A very long text is one slice of its own.
    """
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words longest_repeat".split()
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"

    def make():
        def step(rows):
            m = measure(rows.column("text").to_pylist())
            n = m["n_words"]
            failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
            bad = (m["covered_words"] > max_covered * n) | (m["longest_repeat"] > max_passage)
            return {"doc_id": rows.column("doc_id"), **m, "base_failed": failed, "kept": ~failed & ~bad}
        return step

    return map_slices(id_and_text(docs), make, schema)
