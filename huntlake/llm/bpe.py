"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

1. A task cuts its documents into pre-tokens and numbers the distinct ones of a block of text: a
   document becomes a list of numbers whose order holds the positions.
2. The distinct pre-tokens of all blocks are shuffled by pre-token, so that one task sees every
   occurrence of one in a block and encodes it once.
3. The ids go back to their block, where each document puts them together by position.

Blocks bound what a task holds; a pre-token that occurs everywhere gives one row per block, not
per occurrence, so no key is hot. Decoding looks ids up in the table of token bytes, whose size is
that of the vocabulary; it is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructType

from huntlake.llm.common import id_and_text, slices

BLOCK_BYTES = 32 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def odd_characters() -> str:
    """Letters and numbers of newer Unicode versions, which one of the two libraries does not know."""
    import regex
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    odd = set()
    for kind in (r"\p{L}", r"\p{N}"):
        known = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        mine = "".join(regex.findall(kind + "+", every))
        odd |= set(mine) - set(known.decode(known.encode_ordinary(mine)))
    return "".join(sorted(odd))


def listed(pattern: str, odd: str) -> str | None:
    """``pattern`` for ``re``, which is faster than ``regex`` but lacks ``\\p{}``: letters, numbers and white space up to U+FFFF are listed,
    without the ``odd`` ones. None if the pattern uses more than these and plain characters."""
    import regex

    rest = re.sub(r"\\p\{[LN]\}|\\[srn]", "", re.sub(r"\[[^]]*\]|\\S", lambda m: m.group().strip("\\S"), pattern))
    if "\\" in rest or "[:" in pattern or re.search(r"\(\?[^!=:]", pattern):
        return None
    every, lists = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000)))), {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        code = np.array([ord(c) for c in regex.findall(kind, every) if c not in odd])
        start = np.flatnonzero(np.diff(code, prepend=-2) > 1)
        end = np.r_[start[1:], len(code)] - 1
        lists[kind] = "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in zip(code[start].tolist(), code[end].tolist()))

    def put(m):
        if m.group() == r"\S":
            return f"[^{lists[chr(92) + 's']}]"
        inside = re.sub(r"\\p\{[LN]\}|\\s", lambda x: lists[x.group()], m.group())
        return inside if m.group().startswith("[") else f"[{inside}]"

    return re.sub(r"\[[^]]*\]|\\p\{[LN]\}|\\[sS]", put, pattern)


class Splitter:
    """Pre-tokens of a text, as tiktoken's matches of ``pattern`` are. Texts with characters beyond U+FFFF, or all if there is no
    ``listed`` pattern, are cut by ``regex``, with ``odd_characters`` replaced by one that is neither letter nor number before cutting."""

    def __init__(self, pattern: str, odd: str, listed: str | None = None):
        import regex

        self.matches, self.find = regex.compile(pattern).finditer, regex.compile(pattern).findall
        self.odd, self.plain = frozenset(odd), dict.fromkeys(map(ord, odd), "\ue000")
        self.quick, self.beyond = re.compile(listed).findall if listed else None, re.compile("[\U00010000-\U0010ffff]").search

    def whole(self, text: str) -> list[str]:
        if self.quick and (text.isascii() or not self.beyond(text)):
            return self.quick(text)
        if text.isascii() or self.odd.isdisjoint(text):
            return self.find(text)
        return [text[m.start():m.end()] for m in self.matches(text.translate(self.plain))]


class Numbers(dict):
    """Numbers what it is asked for by first appearance."""

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        return number


class Blocks:
    """Numbers the pre-tokens of a block."""

    def __init__(self, splitter: Splitter, digest: bool = False):
        self.splitter, self.digest = splitter, digest
        self.start()

    def start(self):
        self.numbers = Numbers()
        self.ids: list = []
        self.digests: list[str] = []
        self.docs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, text: str):
        tokens = self.splitter.whole(text)
        self.ids.append(doc_id)
        if self.digest:
            self.digests.append(hashlib.sha256(text.encode()).hexdigest())
        self.docs.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.uint32, len(tokens)))
        self.bytes += len(text)

    def finish(self) -> tuple[int, list[str]]:
        """The block's name and its distinct pre-tokens, numbered anew by falling frequency. The
        name is a hash of those in order: blocks with equal names have equal numbers."""
        tokens = list(self.numbers)
        counts = np.bincount(np.concatenate(self.docs), minlength=len(tokens))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        self.docs = [rank[d] for d in self.docs]
        tokens = [tokens[i] for i in order]
        joined = "".join(f"{len(t)}:{t}" for t in tokens)
        return int.from_bytes(hashlib.blake2b(joined.encode(), digest_size=8).digest(), "little", signed=True), tokens


def blocks_of(batches: Iterator[pa.RecordBatch], splitter: Splitter, block_bytes: int, digest: bool = False) -> Iterator[Blocks]:
    block = Blocks(splitter, digest)
    for batch in batches:
        for rows in slices(batch):
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                block.add(doc_id, text)
            if block.bytes >= block_bytes:
                yield block
                block.start()
    if block.ids:
        yield block


def packed(numbers: np.ndarray) -> bytes:
    """Numbers, mostly small, in one byte each and those from 255 on in two or four more, compressed."""
    press = zstandard.ZstdCompressor(level=3).compress
    rest = numbers[numbers >= 255] - 255
    width = 2 if rest.max(initial=0) < 65536 else 4
    planes = np.ascontiguousarray(rest.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    low = press(np.minimum(numbers, 255).astype(np.uint8).tobytes())
    return len(low).to_bytes(8, "little") + bytes([width]) + low + press(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor().decompress
    split, width = 9 + int.from_bytes(data[:8], "little"), data[8]
    numbers = np.frombuffer(open_(data[9:split]), np.uint8).astype(np.int64)
    planes = np.frombuffer(open_(data[split:]), np.uint8).reshape(width, -1)
    numbers[numbers == 255] += np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
    return numbers


def _width(ranks: dict[bytes, int]) -> str:
    """Bytes of an id: as few as the vocabulary allows."""
    return "<u2" if max(ranks.values(), default=0) < 65536 else "<u4"


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES,
           digest: bool = False, packed: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) per row of ``docs``; with ``digest`` also ``text_sha256``.

    With ``packed`` the ids are binary, compressed and in as few bytes as the vocabulary allows, for
    shuffles that carry them on to ``with_round_trip``.

    NULL text counts as empty and gives an empty array. Repeated rows and equal ids give one
    result each, an empty table gives no rows, other columns are ignored; a very long text is a
    block of its own. The documents are read twice, once for their words and once for their
    positions, which costs less than keeping either. A block is named by its words: if a source
    without a fixed order came out in other blocks at the second reading, their words would be
    missing and the job would fail, not go wrong.
    """
    def lists(doc_ids, flat, offsets, digests):
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
        return {"doc_id": pa.array(doc_ids, pa.int64()), "ids": ids} | (
            {"text_sha256": pa.array(digests, pa.string())} if digest else {})

    def pressed(doc_ids, flat, offsets, digests):
        press = zstandard.ZstdCompressor(level=3).compress
        ids = pa.array([press(flat[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], pa.binary())
        return {"doc_id": pa.array(doc_ids, pa.int64()), "ids": ids} | (
            {"text_sha256": pa.array(digests, pa.string())} if digest else {})

    schema = "doc_id long, ids " + ("binary" if packed else "array<int>") + (", text_sha256 string" if digest else "")
    return _encoded(docs, ranks, pattern, block_bytes, pressed if packed else lists, schema, digest)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``decode`` for the ids of ``encode``. A task decodes the ids where it has put
    them together, so that they need no second Python worker beside the first."""
    shared = docs.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def columns(doc_ids, flat, offsets, digests):
        return {"doc_id": pa.array(doc_ids, pa.int64())} | _decoded(
            [flat[a:b] for a, b in zip(offsets, offsets[1:])], shared.value)

    return _encoded(docs, ranks, pattern, block_bytes, columns, "doc_id long, " + DECODED)


def _encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_bytes: int,
             columns: Callable[[list, np.ndarray, np.ndarray, list], dict], schema: str, digest: bool = False) -> DataFrame:
    """``columns`` gives those of ``schema`` for some documents: their doc_ids, all their ids, where
    those of each document start (and the last end), and with ``digest`` the hashes of their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    source, odd = id_and_text(docs), odd_characters()
    quick = listed(pattern, odd)
    width = _width(ranks)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def words(batches):
        for block in blocks_of(batches, Splitter(pattern, odd, quick), block_bytes):
            name, tokens = block.finish()
            for i in range(0, len(tokens), 20_000):
                part = tokens[i:i + 20_000]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([name] * len(part), pa.int64()),
                    "number": pa.array(range(i, i + len(part)), pa.int32()), "word": pa.array(part, pa.string()),
                })

    def merged(batches):
        import tiktoken

        merge = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=shared.value, special_tokens={})
        last, ids = None, b""
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:  # rows are sorted by word
                    last, ids = word, np.array(merge.encode_ordinary(word), width).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_pydict({
                "block": batch.column("block"), "number": batch.column("number"), "ids": pa.array(out, pa.binary()),
            })

    def places(batches):
        for block in blocks_of(batches, Splitter(pattern, odd, quick), block_bytes, digest):
            name, _ = block.finish()
            for i in range(0, len(block.ids), 512):
                part = block.docs[i:i + 512]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([name], pa.int64()),
                    "doc_ids": pa.array([block.ids[i:i + 512]], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(d) for d in part]], pa.list_(pa.int64())),
                    "numbers": pa.array([packed(np.concatenate(part))], pa.binary()),
                    "digests": pa.array([block.digests[i:i + 512]], pa.list_(pa.string())),
                })

    def assembled(placed: pa.Table, coded: pa.Table) -> pa.Table:
        order = np.unique(coded.column("number").to_numpy(), return_index=True)[1]
        ids = coded.column("ids").combine_chunks().take(pa.array(order))
        length = pa.compute.binary_length(ids).to_numpy() // int(width[-1])
        begin = np.cumsum(length) - length
        flat = np.frombuffer(ids.buffers()[2] or b"", width, length.sum())
        done = []
        for row in range(placed.num_rows):
            sizes = np.array(placed.column("sizes")[row].as_py(), np.int64)
            at = unpacked(placed.column("numbers")[row].as_py())
            if len(at) and at.max() >= len(order):
                raise RuntimeError("the documents came out otherwise at the second reading; write them first")
            take = length[at]
            ends = np.cumsum(take)
            picked = flat[np.repeat(begin[at] - (ends - take), take) + np.arange(take.sum())]
            offsets = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]]
            done.append(pa.table(columns(
                placed.column("doc_ids")[row].as_py(), picked, offsets, placed.column("digests")[row].as_py()), schema=arrow))
        return pa.concat_tables(done) if done else arrow.empty_table()

    coded = (
        source.mapInArrow(words, "block long, number int, word string")
        .repartition("word").sortWithinPartitions("word")
        .mapInArrow(merged, "block long, number int, ids binary")
    )
    placed = source.mapInArrow(places, "block long, doc_ids array<long>, sizes array<long>, numbers binary, digests array<string>")
    return placed.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assembled, schema)


DECODED = "n_tokens long, ids_sha256 string, decoded binary"


def _decoded(ids: list[np.ndarray], tokens: dict[int, bytes]) -> dict:
    """Columns ``DECODED`` for the ids of some documents."""
    token = tokens.__getitem__
    return {
        "n_tokens": pa.array(map(len, ids), pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
        "decoded": pa.array([b"".join(map(token, x.tolist())) for x in ids], pa.binary()),
    }


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and
    ``decoded`` (binary) per row with ``doc_id`` and ``ids``.

    The table of token bytes has one row per vocabulary entry and is broadcast. NULL ids count as
    none; an id that the table lacks is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})

    def decoded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = [np.array([] if x is None else x, np.uint32) for x in map(_values, rows.column("ids"))]
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id")} | _decoded(ids, shared.value))

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, " + DECODED)


def _values(cell: pa.ListScalar):
    return None if cell.values is None else cell.values.to_numpy()


def with_round_trip(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (with ``text_sha256``) as ``doc_id``, ``ids``, ``n_tokens``, ``intact`` (whether
    the ids decode to the very text) and its other columns. Its ids may be packed; an array comes out."""
    shared = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in ranks.items()})
    width, others = _width(ranks), [c for c in encoded.columns if c not in ("doc_id", "ids", "text_sha256")]
    packed = encoded.schema["ids"].dataType == BinaryType()
    schema = StructType.fromDDL("doc_id long, ids array<int>, n_tokens long, intact boolean")
    for c in others:
        schema = schema.add(encoded.schema[c])

    def checked(batches):
        token, open_ = shared.value.__getitem__, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256)
                ids = [np.frombuffer(open_(x.as_py()), width) if packed else _values(x) for x in rows.column("ids")]
                whole = [hashlib.sha256(b"".join(map(token, x.tolist()))).hexdigest() for x in ids]
                lengths = np.array(list(map(len, ids)), np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"),
                    "ids": pa.ListArray.from_arrays(
                        pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(np.concatenate(ids).astype(np.int32), pa.int32())),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "intact": pa.array([a == b for a, b in zip(whole, rows.column("text_sha256").to_pylist())], pa.bool_()),
                } | {c: rows.column(c) for c in others})

    return encoded.mapInArrow(checked, schema)
