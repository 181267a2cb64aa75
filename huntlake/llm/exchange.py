"""Slices of documents, and for keys that slices hold the least owner of each among all slices.

A slice is one stored row with up to a few megabytes of packed texts. What a key by key shuffle would
say with a row per key, slices ask in blocks: each sends, per bucket of the key space, one block
with its sorted keys and, for each, its least owner; a bucket answers each block with the keys that
several owners hold and the least owner. There are never more blocks than keys, a key held by
very many documents comes once per slice, and a bucket holds a set number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.llm.common import map_slices
from huntlake.session import scratch_path

#: About so many keys go to a bucket.
BUCKET_KEYS = 2_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE = "doc_id array<long>, n array<long>, name array<long>, packed array<long>, sizes array<int>, body binary"


@contextmanager
def held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: smaller than a checkpoint, and it cuts lineage as
    well. The shuffle files behind it are not needed once it is written, so Spark drops them."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with held(spark, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def make_slices(docs: DataFrame, make: Callable, extra: str = "") -> DataFrame:
    """Stored slices of ``docs`` (doc_id, text). ``make()`` gives, once per task, a function from
    a list of texts to columns ``n`` (0: nothing to search), ``name`` (equal for equal content) and those of
    ``extra``. Of equal names in a slice, one text is packed."""
    def steps():
        step, press = make(), zstandard.ZstdCompressor(level=3).compress

        def pack(rows):
            texts = rows.column("text").to_pylist()
            out, first = step(texts), {}
            for i, (name, n) in enumerate(zip(out["name"], out["n"])):
                if n:
                    first.setdefault(name, i)
            bodies = [texts[i].encode() for i in first.values()]
            cells = out | {
                "doc_id": rows.column("doc_id").to_pylist(), "packed": list(first),
                "sizes": [len(b) for b in bodies], "body": press(b"".join(bodies)),
            }
            return {k: [v] for k, v in cells.items()}

        return pack

    found = map_slices(docs, steps, SLICE + extra)
    return store(found.withColumn("slice", F.monotonically_increasing_id()), "slices")


def per_document(slices: DataFrame, *names: str) -> DataFrame:
    """``slice`` and the columns ``names``, a row per document."""
    return slices.select("slice", F.explode(F.arrays_zip(*names)).alias("x")).select("slice", *[F.col(f"x.{c}") for c in names])


def unpack(row: dict) -> Iterator[tuple[int, bytes]]:
    """(name, text) of the packed texts of a slice."""
    body, at = zstandard.ZstdDecompressor().decompress(row["body"]), 0
    for name, size in zip(row["packed"], row["sizes"]):
        yield name, body[at:at + size]
        at += size


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind).reshape(n)


def _coded(owner: np.ndarray, tie: np.ndarray) -> tuple[bytes, int]:
    """Owners by their place in a list of the different ones."""
    both, place = np.unique(np.rec.fromarrays([owner, tie], names="o,t"), return_inverse=True)
    return _planes(np.ascontiguousarray(both["o"])) + _planes(np.ascontiguousarray(both["t"])) + _planes(place.astype(np.uint32)), len(both)


def _decoded(data: bytes, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    place = _unplanes(data[16 * m:], np.uint32, n)
    return _unplanes(data[:8 * m], np.int64, m)[place], _unplanes(data[8 * m:16 * m], np.int64, m)[place]


def grouped(key: np.ndarray, owner: np.ndarray, tie: np.ndarray):
    """Sorted different keys, the least (owner, tie) of each, whether it has several, and how many rows."""
    order = np.lexsort((tie, owner, key))
    key, owner, tie = key[order], owner[order], tie[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    end = np.r_[start[1:], len(key)] - 1 if len(key) else start
    several = (owner[start] != owner[end]) | (tie[start] != tie[end])
    return key[start], owner[start], tie[start], several, end - start + 1


def blocks(slice_id: int, key: np.ndarray, owner: np.ndarray, tie: np.ndarray, several: np.ndarray, buckets: int):
    """Rows (bucket, slice, n, m, block) for sorted different uint64 keys."""
    cut = _bounds(key, buckets)
    press = zstandard.ZstdCompressor(level=1).compress
    out = {c: [] for c in ("bucket", "slice", "n", "m", "block")}
    for b in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
        s = slice(cut[b], cut[b + 1])
        coded, m = _coded(owner[s], tie[s])
        block = _planes(np.diff(key[s], prepend=np.uint64(0))) + np.packbits(several[s]).tobytes() + coded
        for c, v in zip(out, (b, slice_id, int(s.stop - s.start), m, press(block))):
            out[c].append(v)
    return out


BLOCK = "bucket int, slice long, n int, m int, block binary"


def block_batch(out: dict) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)})


def _bounds(key: np.ndarray, buckets: int) -> np.ndarray:
    """Where buckets, equal ranges of the key space, start among sorted keys."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(key, edges), len(key)]


def answers(requests: DataFrame) -> DataFrame:
    """``slice`` and ``answers`` (bucket, n, m, block) for its blocks: which keys several owners
    hold, and the least owner of those."""
    def bucket(table: pa.Table) -> pa.Table:
        open_, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        keys, owners, ties, flags = [], [], [], []
        sizes = table.column("n").to_pylist()
        for n, m, block in zip(sizes, table.column("m").to_pylist(), table.column("block")):
            data, bits = open_(block.as_py()), (n + 7) // 8
            keys.append(np.cumsum(_unplanes(data[:8 * n], np.uint64, n), dtype=np.uint64))
            flags.append(np.unpackbits(np.frombuffer(data[8 * n:8 * n + bits], np.uint8), count=n).astype(bool))
            owner, tie = _decoded(data[8 * n + bits:], m, n)
            owners.append(owner)
            ties.append(tie)
        key, owner, tie, flag = map(np.concatenate, (keys, owners, ties, flags))
        known, least, least_tie, several, _ = grouped(key, owner, tie)
        at = np.searchsorted(known, key)
        several |= np.bincount(at[flag], minlength=len(known)) > 0
        out, end = {c: [] for c in ("slice", "bucket", "n", "m", "block")}, 0
        for s, b, n in zip(table.column("slice").to_pylist(), table.column("bucket").to_pylist(), sizes):
            mine = at[end:end + n]
            end += n
            yes = several[mine]
            if yes.any():
                coded, m = _coded(least[mine[yes]], least_tie[mine[yes]])
                for c, v in zip(out, (s, b, n, m, press(np.packbits(yes).tobytes() + coded))):
                    out[c].append(v)
        return pa.table({"slice": pa.array(out["slice"], pa.int64()), "bucket": pa.array(out["bucket"], pa.int32()), "n": pa.array(out["n"], pa.int32()),
                         "m": pa.array(out["m"], pa.int32()), "block": pa.array(out["block"], pa.binary())})

    found = requests.groupBy("bucket").applyInArrow(bucket, "slice long, bucket int, n int, m int, block binary")
    return found.groupBy("slice").agg(F.collect_list(F.struct("bucket", "n", "m", "block")).alias("answers"))


def read_answers(key: np.ndarray, cells: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the sorted different keys a slice asked about: held by several, and the least owner and tie then."""
    yes, owner, tie = np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    cut, open_ = _bounds(key, buckets), zstandard.ZstdDecompressor().decompress
    for cell in cells or ():
        n, data = cell["n"], open_(cell["block"])
        bits = (n + 7) // 8
        found = cut[cell["bucket"]] + np.flatnonzero(np.unpackbits(np.frombuffer(data[:bits], np.uint8), count=n))
        yes[found] = True
        owner[found], tie[found] = _decoded(data[bits:], cell["m"], len(found))
    return yes, owner, tie


def bucket_count(df: DataFrame, keys: int) -> int:
    """Buckets for so many keys: enough for every shuffle partition, and none too large."""
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(keys) // BUCKET_KEYS))
