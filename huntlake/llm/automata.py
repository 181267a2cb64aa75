"""Weighted acyclic automata over words: which sequences of words a shard has, and how often.

An automaton reads a language and then up to three words; every arc has a weight, and the weight of
the last arc read is the count of the sequence read so far. States with nothing below them are one.
Arcs lie level by level in flat arrays, in the order of what is read up to them, so a range of
sequences is one run of arcs on each level:

* ``Builder`` appends the counts of a shard's sorted sequences, ``union`` adds automata up,
* ``split`` cuts one at the borders of ranges (a border may lie anywhere, also below a frequent word),
* ``find`` composes an automaton with sequences asked for, given as another automaton.

Words are kept as bytes; nothing is decided by a hash of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

LEVELS = 4  # the language and three words
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_CUTS = b" \t\n\x0b\x0c\r.,;:!?"
_SHIFT = np.int64(32)
SEGMENT_BYTES = 2 << 20


@dataclass
class Automaton:
    langs: pa.Array
    words: pa.Array           # sorted; the words of the arcs
    parent: list[np.ndarray]  # of level k: the arc of level k - 1 that leads here (level 0: zeros)
    label: list[np.ndarray]   # place in langs (level 0) or words
    weight: list[np.ndarray]

    @property
    def arcs(self) -> int:
        return sum(map(len, self.label))


def _binary(values: Sequence[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _merge(key: np.ndarray, weight: np.ndarray, how: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, where each key given is among them, and their weights put together."""
    if not len(key):
        return key, np.empty(0, np.int64), weight
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return key[first], place, how.reduceat(weight[order], first)


def _ranked(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Sorted different values, and the place of each value given among them."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _of_levels(langs: pa.Array, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray]]) -> Automaton:
    """From sorted keys (parent << 32 | label) and weights of each level."""
    return Automaton(langs, words, [k >> _SHIFT for k, _ in levels], [k & 0xFFFFFFFF for k, _ in levels], [w for _, w in levels])


class Builder:
    """Counts the sequences of up to three words of texts. Words are lower-cased (A-Z) and end at blanks, tabs and
    ``[.,;:!?\\x0A-\\x0D]``; no sequence goes across the latter or from one text to the next."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self._clear()

    def _clear(self):
        self.ids, self.lang, self.new, self.n, self.before = [], [], [], 0, 0

    def add(self, texts: list[bytes], langs: list[bytes]) -> None:
        lang = [self.codes.setdefault(x, len(self.codes)) for x in langs]
        i = 0
        while i < len(texts):
            j, size = i + 1, len(texts[i])
            while j < len(texts) and size + len(texts[j]) <= SEGMENT_BYTES:
                size += len(texts[j]) + 1
                j += 1
            if size <= 2 * SEGMENT_BYTES:
                self._segment(b"\n".join(texts[i:j]), np.cumsum([0] + [len(t) + 1 for t in texts[i:j - 1]]), np.array(lang[i:j], np.int64), True)
            else:
                self._long(texts[i], lang[i])
            i = j

    def _long(self, text: bytes, lang: int) -> None:
        at = 0
        while at < len(text):
            end = min(at + SEGMENT_BYTES, len(text))
            if end < len(text):
                last = max(text.rfind(c, at, end) for c in _CUTS)
                if last < 0:
                    found = [text.find(c, end) for c in _CUTS]
                    last = min((f for f in found if f >= 0), default=len(text) - 1)
                end = last + 1
            self._segment(text[at:end], np.zeros(1, np.int64), np.array([lang], np.int64), at == 0)
            at = end

    def _segment(self, data: bytes, starts: np.ndarray, lang: np.ndarray, fresh: bool) -> None:
        """``starts``: where the texts start; ``fresh``: the first one starts here, not earlier."""
        raw = _LOWER[np.frombuffer(data, np.uint8)]
        kind = _KIND[raw]
        breaks = np.flatnonzero(kind == 2)
        inside = kind == 0
        word = np.r_[False, inside, False]
        change = np.flatnonzero(word[1:] != word[:-1])
        start, end = change[::2], change[1::2]
        if len(start):
            offsets = np.r_[0, np.cumsum(end - start)].astype(np.int32)
            self.ids.append(pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode())
            self.lang.append(lang[np.searchsorted(starts, start, "right") - 1].astype(np.int32))
            piece = np.searchsorted(breaks, start)
            self.new.append(np.r_[fresh or self.broken or piece[0] > 0, piece[1:] != piece[:-1]])
            self.n += len(start)
            self.broken = len(breaks) > piece[-1]
        else:
            self.broken = fresh or self.broken or len(breaks) > 0

    broken = True

    def take(self) -> Automaton | None:
        """What was added since the last call. The last two words stay as the beginning of what
        may follow in the same text."""
        if self.n == self.before:
            return None
        coded = pa.chunked_array(self.ids).unify_dictionaries().combine_chunks()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        ids, new, lang = rank[coded.indices.to_numpy()], np.concatenate(self.new), np.concatenate(self.lang)
        langs, place = _ranked(_binary(list(self.codes)))
        lang, n, own = place[lang], len(ids), self.before
        code = np.concatenate(self.lang)[max(n - 2, 0):]
        last = np.arange(n) >= own
        total = np.bincount(lang[own:], minlength=len(langs)).astype(np.int64)
        levels = [(np.arange(len(langs), dtype=np.int64), total)]
        key, at, weight = _merge(lang << _SHIFT | ids, last.astype(np.int64), np.add)
        levels.append((key, weight))
        where = np.arange(n)
        for k in (1, 2):
            where = where[where + k < n]
            go = ~new[where + k]
            where, at = where[go], at[:len(go)][go]
            key, at, weight = _merge(at << _SHIFT | ids[where + k], last[where + k].astype(np.int64), np.add)
            levels.append((key, weight))
        out = _of_levels(langs, coded.dictionary.take(order), levels)
        keep = min(2, n)
        tail = coded.slice(n - keep, keep).dictionary_decode().dictionary_encode()
        self._clear()
        self.ids, self.lang, self.new, self.n, self.before = [tail], [code], [new[n - keep:]], keep, keep
        return out


def of_sequences(langs: pa.Array, words: pa.Array, lang: np.ndarray, ids: np.ndarray, weight: np.ndarray, how: np.ufunc) -> Automaton:
    """From sequences given as rows of places in ``langs`` and (up to two columns) in ``words``, -1 after the last."""
    levels, at, rows = [(np.arange(len(langs), dtype=np.int64), np.zeros(len(langs), np.int64))], lang, np.arange(len(lang))
    for k in range(LEVELS - 1):
        column = ids[rows, k] if k < ids.shape[1] else np.full(len(rows), -1)
        go = column >= 0
        rows, at = rows[go], at[go]
        ends = ids[rows, k + 1] < 0 if k + 1 < ids.shape[1] else np.ones(len(rows), bool)
        key, at, w = _merge(at << _SHIFT | column[go], np.where(ends, weight[rows], 0), how)
        levels.append((key, w))
    return _of_levels(langs, words, levels)


def union(parts: Sequence[Automaton], how: np.ufunc = np.add) -> Automaton:
    """All sequences of all parts, their weights put together."""
    if len(parts) == 1:
        return parts[0]
    langs, lang = _ranked(pa.concat_arrays([p.langs for p in parts]))
    words, word = _ranked(pa.concat_arrays([p.words for p in parts]))
    first_lang, first_word = np.cumsum([0] + [len(p.langs) for p in parts]), np.cumsum([0] + [len(p.words) for p in parts])
    levels, place, first = [], None, None
    for k in range(LEVELS):
        if k == 0:
            key = np.concatenate([lang[f + p.label[0]] for f, p in zip(first_lang, parts)])
        else:
            key = np.concatenate([place[f + p.parent[k]] << _SHIFT | word[g + p.label[k]] for f, g, p in zip(first, first_word, parts)])
        first = np.cumsum([0] + [len(p.label[k]) for p in parts])
        key, place, weight = _merge(key, np.concatenate([p.weight[k] for p in parts]), how)
        levels.append((key, weight))
    return _of_levels(langs, words, levels)


def compact(a: Automaton, keep: list[np.ndarray]) -> Automaton:
    """The arcs ``keep`` says (with all arcs above them), and the words they need."""
    parent, label, weight, place = [], [], [], None
    for k in range(LEVELS):
        rows = np.flatnonzero(keep[k])
        parent.append(place[a.parent[k][rows]] if k else np.zeros(len(rows), np.int64))
        label.append(a.label[k][rows])
        weight.append(a.weight[k][rows])
        place = np.cumsum(keep[k]) - 1
    used = np.zeros(len(a.words), bool)
    for x in label[1:]:
        used[x] = True
    rank = np.cumsum(used) - 1
    langs = np.zeros(len(a.langs), bool)
    langs[label[0]] = True
    label = [(np.cumsum(langs) - 1)[label[0]], *[rank[x] for x in label[1:]]]
    return Automaton(a.langs.filter(pa.array(langs)), a.words.filter(pa.array(used)), parent, label, weight)


def frequent(a: Automaton, least: int) -> Automaton:
    """Without the sequences that occur less than ``least`` times."""
    keep = [w >= least for w in a.weight]
    keep[0] = a.weight[0] > 0
    for k in range(LEVELS - 1, 0, -1):
        keep[k - 1][a.parent[k][keep[k]]] = True
    return compact(a, keep)


def sequences(a: Automaton, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``langs``, and rows of places in ``words``, of the arcs of a level."""
    columns, at = [], np.arange(len(a.label[level]))
    for k in range(level, 0, -1):
        columns.append(a.label[k][at])
        at = a.parent[k][at]
    return a.label[0][at], np.array(columns[::-1], np.int64).T.reshape(len(at), level)


def _places(of: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(of, value_set=among), -1).to_numpy().astype(np.int64)


def find(a: Automaton, asked: Automaton) -> list[np.ndarray]:
    """For each arc of ``asked``: the arc of ``a`` that reads the same, -1 if there is none."""
    word, at, out = _places(asked.words, a.words), None, []
    for k in range(LEVELS):
        if k == 0:
            label, above, go = _places(asked.langs, a.langs)[asked.label[0]], np.zeros(len(asked.label[0]), np.int64), True
        else:
            label, above, go = word[asked.label[k]], at[asked.parent[k]], at[asked.parent[k]] >= 0
        key = a.parent[k] << _SHIFT | a.label[k]
        want = above << _SHIFT | np.maximum(label, 0)
        place = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        hit = (label >= 0) & go & (key[place] == want) if len(key) else np.zeros(len(want), bool)
        at = np.where(hit, place, -1)
        out.append(at)
    return out


Border = tuple[bytes, bytes, bytes, bytes]


def borders(a: Automaton, n: int) -> list[Border]:
    """``n`` sequences, evenly spaced among the longest ones."""
    level = next((k for k in (3, 2, 1) if len(a.label[k])), 0)
    if not level:
        return []
    lang, ids = sequences(a, level)
    at = np.unique(np.linspace(0, len(lang) - 1, n).astype(int))
    return [(a.langs[int(lang[i])].as_py(), *[a.words[int(w)].as_py() for w in ids[i]], *[b""] * (3 - level)) for i in at]


def _cuts(a: Automaton, marks: Sequence[Border]) -> np.ndarray:
    """How many arcs of each level come before each mark."""
    words, langs = np.array(a.words.to_pylist() + [None], object)[:-1], a.langs.to_pylist()
    out = np.zeros((len(marks), LEVELS), np.int64)
    for i, mark in enumerate(marks):
        at, below = None, 0  # the arc that reads the mark so far; else arcs of the level above before the mark
        for k in range(LEVELS):
            if k and at is None:
                below = int(np.searchsorted(a.parent[k], below))
                out[i, k] = below
                continue
            lo, hi = (0, len(a.label[0])) if k == 0 else np.searchsorted(a.parent[k], [at, at + 1])
            if k and not mark[k]:  # the mark ended above: everything under it comes later
                out[i, k], at, below = lo, None, int(lo)
                continue
            rank = int(np.searchsorted(np.array(langs, object), mark[0])) if k == 0 else int(np.searchsorted(words, mark[k]))
            exact = rank < (len(langs) if k == 0 else len(words)) and (langs[rank] if k == 0 else words[rank]) == mark[k]
            p = int(lo) + int(np.searchsorted(a.label[k][lo:hi], rank))
            more = k + 1 < LEVELS and bool(mark[k + 1])
            if exact and p < hi and a.label[k][p] == rank:
                out[i, k] = p + more
                at = p
            else:
                out[i, k], at, below = p, None, p
    return out


def split(a: Automaton, marks: Sequence[Border]) -> Iterator[tuple[int, Automaton]]:
    """(range, part) for the ranges between sorted marks that ``a`` has something in. Arcs above a part's own are
    there with weight 0."""
    cuts = np.vstack([np.zeros((1, LEVELS), np.int64), _cuts(a, marks), [[len(x) for x in a.label]]])
    for r in np.flatnonzero((cuts[1:] > cuts[:-1]).any(axis=1)).tolist():
        lo, hi = cuts[r].copy(), cuts[r + 1].copy()
        weight = [None] * LEVELS
        for k in range(LEVELS - 1, -1, -1):
            own_lo, own_hi = cuts[r, k], cuts[r + 1, k]
            if k + 1 < LEVELS and hi[k + 1] > lo[k + 1]:
                above = a.parent[k + 1][[lo[k + 1], hi[k + 1] - 1]]
                lo[k], hi[k] = (min(lo[k], above[0]), max(hi[k], above[1] + 1)) if hi[k] > lo[k] else (above[0], above[1] + 1)
            weight[k] = a.weight[k][lo[k]:hi[k]].copy()
            weight[k][:max(own_lo - lo[k], 0)] = 0
            weight[k][max(own_hi - lo[k], 0):] = 0
        part = Automaton(a.langs, a.words, [a.parent[k][lo[k]:hi[k]] - (lo[k - 1] if k else 0) for k in range(LEVELS)],
                         [a.label[k][lo[k]:hi[k]] for k in range(LEVELS)], weight)
        yield r, compact(part, [np.ones(len(x), bool) for x in part.label])


def _planes(values: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T).tobytes()


def dump(a: Automaton) -> bytes:
    texts = [pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (a.langs, a.words)]
    parts = [_planes(x, np.uint32) for x in texts] + [b"".join(a.langs.to_pylist()), b"".join(a.words.to_pylist())]
    for k in range(LEVELS):
        if k:
            parts.append(_planes(np.bincount(a.parent[k], minlength=len(a.label[k - 1])), np.uint32))
        parts += [_planes(a.label[k], np.uint32), _planes(a.weight[k], np.int64)]
    sizes = [len(a.langs), len(a.words), *map(len, a.label), len(parts[2]), len(parts[3])]
    return struct.pack("<8q", *sizes) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def load(block: bytes) -> Automaton:
    n_langs, n_words, *n, langs_bytes, words_bytes = struct.unpack_from("<8q", block)
    data, at = zstandard.ZstdDecompressor().decompress(block[64:]), 0

    def values(count, kind):
        nonlocal at
        size = count * np.dtype(kind).itemsize
        x = np.frombuffer(data, np.uint8, size, at).reshape(-1 if count else np.dtype(kind).itemsize, count)
        at += size
        return np.ascontiguousarray(x.T).view(kind).reshape(count).astype(np.int64)

    lengths = values(n_langs, np.uint32), values(n_words, np.uint32)
    texts = []
    for length, size in zip(lengths, (langs_bytes, words_bytes)):
        offsets = np.r_[0, np.cumsum(length)].astype(np.int32)
        texts.append(pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data[at:at + size])]))
        at += size
    parent, label, weight = [], [], []
    for k in range(LEVELS):
        parent.append(np.repeat(np.arange(n[k - 1]), values(n[k - 1], np.uint32)) if k else np.zeros(n[0], np.int64))
        label.append(values(n[k], np.uint32))
        weight.append(values(n[k], np.int64))
    return Automaton(*texts, parent, label, weight)


def union_all(blocks: Iterable[bytes], how: np.ufunc = np.add, arcs: int = 2_000_000) -> Automaton | None:
    """``union`` of blocks, put together as soon as ``arcs`` wait, so that memory follows the result."""
    waiting, held, done = [], 0, 0
    for block in blocks:
        waiting.append(load(block))
        held += waiting[-1].arcs
        if held - done > max(arcs, done):
            waiting = [union(waiting, how)]
            held = done = waiting[0].arcs
    return union(waiting, how) if waiting else None
