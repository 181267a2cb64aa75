"""Words, shingles and windows of words as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Words of more bytes are hashed one by one; the others in pieces of so many bytes of text.
LONG, PIECE = 64, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)
_POWERS = np.multiply.accumulate(np.full(PIECE + 1, _BASE, np.uint64))
_INVERSES = np.multiply.accumulate(np.full(PIECE + 1, pow(_BASE, -1, 1 << 64), np.uint64))


class WordHashes:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts: a polynomial in the bytes of a word, taken
    from running sums over the text, or xxh3 for the long ones."""

    def __init__(self, lower: bool):
        self.lower = lower

    def words(self, text: str) -> list[bytes]:
        data = text.encode()
        return (data.lower() if self.lower else data).split()  # bytes: A-Z and ASCII white space only

    def many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one after the other, and where each text starts among
        them (one entry more than texts)."""
        joined = b" ".join([b"", *texts, b""])
        data = np.frombuffer(joined.lower() if self.lower else joined, np.uint8)
        space = (data == 32) | ((data - np.uint8(9)) < 5)
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = change[::2], change[1::2]
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            low = start[i]
            j = max(int(np.searchsorted(end, low + PIECE, "right")), i + 1)
            piece = data[low:min(end[j - 1], low + PIECE)]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTES[piece] * _POWERS[:len(piece)], out=sums[1:])
            s, e = start[i:j] - low, np.minimum(end[i:j] - low, len(piece))
            out[i:j] = mixed((sums[e] - sums[s]) * _INVERSES[s] + (e - s).astype(np.uint64) * _MIX)
            i = j
        for i in np.flatnonzero(end - start > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(data[start[i]:end[i]].tobytes())
        borders = np.r_[1, 1 + np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)] if texts else np.ones(1, np.int64)
        return out, np.searchsorted(start, borders)

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text.encode()])[0]

    def shingle_sets(self, texts: list[bytes], k: int) -> list[np.ndarray]:
        """``shingles`` of each text."""
        h, at = self.many(texts)
        all_, out = runs(h, k), []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            out.append(np.unique(all_[lo:hi - k + 1]) if hi - lo >= k else shingles(h[lo:hi], k))
        return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (empty when there are fewer). A run of 2k words
    is mixed from two of k, so the cost grows with the logarithm of ``k``."""
    out, done, size, power = None, 0, 1, mixed(h + _MIX)
    n = len(h)
    if n < k or k < 1:
        return np.empty(0, np.uint64)
    while True:
        if k & size:
            if out is None:
                out = power
            else:
                m = n - done - size + 1
                out = mixed(out[:m] * _MIX + power[done:done + m])
            done += size
        if done == k:
            return out[: n - k + 1]
        power = mixed(power[:len(power) - size] * _MIX + power[size:] + np.uint64(1))
        size *= 2


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; of fewer words the whole sequence as one;
    none of no words."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(runs(h, min(k, len(h))) if len(h) >= k else runs(h, len(h)) ^ np.uint64(len(h)))


def digest(values: np.ndarray) -> int:
    """Signed 64-bit hash of a sequence of hashes."""
    h = xxhash.xxh3_64_intdigest(values.tobytes(), seed=len(values))
    return h - (1 << 64) if h >= 1 << 63 else h
