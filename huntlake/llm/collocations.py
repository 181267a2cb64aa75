"""Phrase collocations by counting automata.

1. Each task counts the sequences of up to three words of its documents in automata (``automata``), cuts these at the
   borders of ranges of sequences, and sends the parts away. The borders come from a random sample of
   documents and only say what goes where; a frequent word or pair is spread over ranges like any other. Where there
   are more than ``FAN`` ranges, chunks are cut into wide ranges, put together in groups, and cut again, so that the number of
   blocks stays far below chunks times ranges.
2. Each range adds its parts up, so its counts are whole, and drops what is rarer than ``least``: no part of a
   candidate is rarer than the candidate.
3. Each range asks, in one automaton per range asked, for the parts of its candidates, each part once however
   many candidates have it, with the largest count of a longer candidate around it. The ranges asked compose
   the question with their counts, answer, and see which of their own candidates a longer one covers.
4. Each range scores its candidates with exact integers and hands on its best; the best of those are ranked.

Texts that are NULL are empty, a NULL language is ``und``; repeated rows count as often as they occur; an empty table
gives no rows; other columns are ignored. Texts of any length are read in segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from huntlake.llm import automata
from huntlake.llm.automata import Automaton
from huntlake.llm.common import slices
from huntlake.llm.exchange import store

LEAST, TOP, COVERED = 10, 2000, 50
#: Words a task counts before it sends its counts away, and bytes of text a range stands for.
CHUNK_WORDS = 1_000_000
RANGE_BYTES = 8 << 20
#: About so many bytes of text give the borders of ranges, and so many borders are looked at.
SAMPLE_BYTES = 32 << 20
SAMPLE_BORDERS = 200_000
#: Ranges whose best meet in one task before the last ranking.
MEET = 64
#: A chunk is cut into at most about so many blocks at once; beyond, ranges are first joined to wide ones.
FAN = 4096
#: Bytes of text that the first step puts together in one group of a wide range.
GROUP_BYTES = 64 << 20
BLOCK = "range int, kind int, origin int, block binary"
_BLOCK = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("origin", pa.int32()), ("block", pa.binary())])
COUNTS, ASKED, ANSWER, GONE = range(4)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(_BLOCK)], schema=_BLOCK)


def _counted(batches, words: int):
    """Automata of the documents of a task, of about ``words`` words each."""
    builder = automata.Builder()
    for batch in batches:
        for piece in slices(batch):
            builder.add(piece.column("text").to_pylist(), piece.column("lang").to_pylist())
            if builder.n >= words:
                if (out := builder.take()) is not None:
                    yield out
                    del out
                    pa.default_memory_pool().release_unused()
    if (out := builder.take()) is not None:
        yield out


def _marks(texts: DataFrame, total: int, ranges: int) -> list[automata.Border]:
    """Sorted borders between ranges, from a sample of bounded size."""
    if ranges < 2:
        return []
    share = min(1.0, SAMPLE_BYTES / max(total, 1))
    each = max(ranges, min(2000, SAMPLE_BORDERS // 32))

    def some(batches):
        for a in _counted(batches, CHUNK_WORDS):
            found = automata.borders(a, each)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.binary()) for i in range(4)], names=list("abcd"))

    part = texts if share == 1 else texts.sample(share, 11)
    # random order and a limit: what is looked at stays bounded when the sample falls out large
    found = part.mapInArrow(some, "a binary, b binary, c binary, d binary").orderBy(F.rand(5)).limit(SAMPLE_BORDERS).toArrow()
    marks = sorted(set(zip(*[found.column(c).to_pylist() for c in "abcd"])))
    return [marks[i] for i in sorted({len(marks) * r // ranges for r in range(1, ranges)} - {0})] if marks else []


def _asked(a: Automaton) -> Automaton:
    """The parts of all candidates, with 1 + the largest count of a longer candidate around them."""
    lang, ids, weight = [], [], []
    for level, parts in ((2, ([0], [1])), (3, ([0], [1, 2], [0, 1], [2]))):
        langs, rows = automata.sequences(a, level)
        own = a.weight[level] > 0
        for part in parts:
            lang.append(langs[own])
            ids.append(np.c_[rows[own][:, part], np.full((own.sum(), 2 - len(part)), -1)])
            weight.append(1 + (a.weight[level][own] if level == 3 and len(part) == 2 else np.zeros(own.sum(), np.int64)))
    asked = automata.of_sequences(a.langs, a.words, np.concatenate(lang), np.concatenate(ids).astype(np.int64), np.concatenate(weight), np.maximum)
    return asked


def _composed(counts: Automaton | None, asked: list[tuple[int, Automaton]], covered: int):
    """(origin, answer) for each question, and the pairs of words that a longer candidate covers."""
    gone = None
    if counts is not None:
        around = np.zeros(len(counts.label[2]), np.int64)
    for origin, q in asked:
        at = automata.find(counts, q) if counts is not None else [np.full(len(x), -1) for x in q.label]
        weight = []
        for k in range(automata.LEVELS):
            known = (at[k] >= 0) & (q.weight[k] > 0) & (k > 0)
            out = np.zeros(len(at[k]), np.int64)
            if known.any():
                out[known] = counts.weight[k][at[k][known]]
            weight.append(out)
            if k == 2 and known.any():
                np.maximum.at(around, at[k][known], q.weight[k][known] - 1)
        yield origin, Automaton(q.langs, q.words, q.parent, q.label, weight)
    if counts is not None:
        hit = (around > 0) & (counts.weight[2] > 0) & (100 * around.astype(object) >= covered * counts.weight[2].astype(object))
        if hit.any():
            keep = [np.zeros(len(x), bool) for x in counts.label]
            keep[2][hit] = True
            for k in (2, 1):
                keep[k - 1][counts.parent[k][keep[k]]] = True
            gone = automata.compact(counts, keep)
            yield None, gone


def floor_score(a: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """floor(1000000 a a / (l r)), exact: with Python's integers where 64 bits may not do."""
    safe = (a < 3_000_000) & (l < 1 << 31) & (r < 1 << 31)
    out = np.zeros(len(a), np.int64)
    out[safe] = 1_000_000 * a[safe] * a[safe] // (l[safe] * r[safe])
    for i in np.flatnonzero(~safe).tolist():
        out[i] = 1_000_000 * int(a[i]) ** 2 // (int(l[i]) * int(r[i]))
    return out


def _scored(a: Automaton, answers: Automaton | None, gone: Automaton | None, top: int):
    """(lang, phrase, a, l, r, score) of the best ``top`` of each language."""
    cells = []
    for level, cuts in ((2, (1,)), (3, (1, 2))):
        langs, rows = automata.sequences(a, level)
        own = a.weight[level] > 0
        if level == 2 and gone is not None:
            at = automata.find(a, gone)[2]
            own[at[at >= 0]] = False
        langs, rows, f = langs[own], rows[own], a.weight[level][own]
        if not len(f):
            continue

        def count(part):
            ids = np.c_[rows[:, part], np.full((len(rows), 2 - len(part)), -1)].astype(np.int64)
            asked = automata.of_sequences(a.langs, a.words, langs, ids, np.ones(len(rows), np.int64), np.maximum)
            at = automata.find(answers, asked)[len(part)]
            value = answers.weight[len(part)][at]
            key = asked.parent[len(part)] << np.int64(32) | asked.label[len(part)]
            if len(part) == 1:
                return value[np.searchsorted(key, langs << np.int64(32) | rows[:, part[0]])]
            first = asked.parent[1] << np.int64(32) | asked.label[1]
            above = np.searchsorted(first, langs << np.int64(32) | rows[:, part[0]])
            return value[np.searchsorted(key, above << np.int64(32) | rows[:, part[1]])]

        best = None
        for cut in cuts:
            l, r = count(list(range(cut))), count(list(range(cut, level)))
            s = floor_score(f, l, r)
            if best is None:
                best = [s, l, r]
            else:
                less = s < best[0]
                best = [np.where(less, x, y) for x, y in zip((s, l, r), best)]
        words = [a.words.take(pa.array(rows[:, i])) for i in range(level)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary()))
        cells.append((pa.array(langs), phrase, pa.array(f), pa.array(best[1]), pa.array(best[2]), pa.array(best[0])))
    if not cells:
        return None
    table = pa.table([pa.concat_arrays(x) for x in zip(*cells)], names=["lang", "phrase", "a", "l", "r", "score"])
    table = table.sort_by([("lang", "ascending"), ("score", "descending"), ("a", "descending"), ("phrase", "ascending")])
    lang = table.column("lang").to_numpy()
    rank = np.arange(len(lang)) - np.searchsorted(lang, lang)
    table = table.filter(pa.array(rank < top))
    table = table.set_column(0, "lang", a.langs.take(table.column("lang").combine_chunks()).cast(pa.string()))
    return table.set_column(1, "phrase", table.column("phrase").combine_chunks().cast(pa.string()))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED,
                 chunk_words: int = CHUNK_WORDS, range_bytes: int = RANGE_BYTES, fan: int = FAN, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the best ``top`` phrases of two or three words of each language, from
    ``least`` occurrences on: ``a`` is how often the phrase occurs, ``l`` and ``r`` how often the two parts do at the cut with
    the lowest score, floor(1000000 a a / (l r)), and ``n`` the number of words of the language. A pair is left out when a longer candidate
    around it has at least ``covered`` percent of its occurrences. Missing values, ties, repeated rows and empty tables: see the head
    of the module."""
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                        F.coalesce(F.col("lang"), F.lit("und")).cast("binary").alias("lang"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    marks = _marks(texts, total, -(-total // range_bytes))
    # bounded: fewer borders than ranges, each as long as three words of the texts
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    wide, wide_first = marks[fan - 1::fan], len(marks) > fan
    groups = max(1, total // max(group_bytes * (len(wide) + 1), 1))

    def count(batches):
        partition = TaskContext.get().partitionId()
        for i, a in enumerate(_counted(batches, chunk_words)):
            for r, part in automata.split(a, shared.value[fan - 1::fan] if wide_first else shared.value):
                yield _rows([(r, COUNTS, (partition * 31 + i) % groups, automata.dump(part))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automata.union_all(b for batch in batches for b in batch.column("block").to_pylist())
        for r, part in automata.split(found, shared.value):
            yield _rows([(r, COUNTS, -1, automata.dump(part))])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automata.union_all(b for batch in batches for b in batch.column("block").to_pylist())
        yield _rows([(key[0].as_py(), COUNTS, -1, automata.dump(automata.frequent(found, least)))])

    sent = texts.mapInArrow(count, BLOCK)
    if wide_first:
        sent = sent.groupBy("range", "origin").applyInArrow(gather, BLOCK)
    counts = store(sent.groupBy("range").applyInArrow(add, BLOCK), "collocation-counts")

    def ask(batches):
        for batch in batches:
            for origin, block in zip(batch.column("range").to_pylist(), batch.column("block").to_pylist()):
                for r, part in automata.split(_asked(automata.load(block)), shared.value):
                    yield _rows([(r, ASKED, origin, automata.dump(part))])

    def compose(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = None, []
        for batch in batches:
            for kind, origin, block in zip(*[batch.column(c).to_pylist() for c in ("kind", "origin", "block")]):
                if kind == COUNTS:
                    own = automata.load(block)
                else:
                    asked.append((origin, block))
        for origin, found in _composed(own, ((o, automata.load(b)) for o, b in asked), covered):
            kind = GONE if origin is None else ANSWER
            yield _rows([(key[0].as_py() if origin is None else origin, kind, key[0].as_py(), automata.dump(found))])

    answers = counts.mapInArrow(ask, BLOCK).unionByName(counts).groupBy("range").applyInArrow(compose, BLOCK)
    schema = "lang string, phrase string, a long, l long, r long, score long, range int"

    def score(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gone, told = None, None, []
        for batch in batches:
            for kind, block in zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist()):
                if kind == COUNTS:
                    own = automata.load(block)
                elif kind == GONE:
                    gone = automata.load(block)
                else:
                    told.append(block)
        found = _scored(own, automata.union_all(told, np.maximum), gone, top) if own is not None and told else None
        if found is not None:
            for batch in found.append_column("range", pa.array([key[0].as_py()] * len(found), pa.int32())).to_batches():
                yield batch

    scored = answers.unionByName(counts).groupBy("range").applyInArrow(score, schema)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if len(marks) >= MEET:
        meet = Window.partitionBy("lang", F.floor(F.col("range") / MEET)).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(meet)).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)

    def totals(batches):
        for batch in batches:
            for block in batch.column("block").to_pylist():
                a = automata.load(block)
                yield pa.RecordBatch.from_arrays([a.langs.take(pa.array(a.label[0])).cast(pa.string()), pa.array(a.weight[0])], names=["lang", "n"])

    words = counts.mapInArrow(totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
