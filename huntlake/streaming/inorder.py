"""Event-time order inside a key of a stream: rows wait until the watermark says that none before them can come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows are taken by whole cells, so at most this long after the watermark passes them.
CELL_SECONDS = 60
CELL_US = CELL_SECONDS * 1_000_000
#: Width of the newest part that rows are put away in; older parts are twice as wide each.
PART_US = 30 * CELL_US
#: Keys share the state of a shard. The number belongs to the state: a stream goes on with the one it began with.
SHARDS = 128
#: About so many rows of a shard are put away, or taken, at once.
CHUNK_ROWS = 500_000
ROW = np.dtype([("t", "<i8"), ("known", "?"), ("id", "<i8"), ("kind", "u1")])
LONG_AGO = -(1 << 62)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of ``transformWithState`` lives in RocksDB; sessions of ``build_session`` have it already."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def sharded(df: DataFrame, key: str, ts: str, event_id: str, *more: Column, kind: Column | None = None):
    """``df`` as ``InOrder`` wants it, grouped by a hash of the key (and ``more``)."""
    return df.select(
        F.pmod(F.xxhash64(key, *more), F.lit(SHARDS)).alias("shard"), F.col(key).alias("key"), F.col(ts).alias("t"),
        F.col(event_id).isNotNull().alias("known"), F.coalesce(F.col(event_id).cast("long"), F.lit(0)).alias("id"),
        (F.lit(0) if kind is None else kind).cast("byte").alias("kind")).groupBy("shard")


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class InOrder(StatefulProcessor):
    """Rows (key, time, id, kind) of a shard wait until the watermark has passed their cell of ``CELL_SECONDS``, since until then earlier
    ones may still come. A timer at the first cell that waits then hands all that are passed to ``take_all``, in time order.

    A call of the state costs more than a row, so a micro-batch puts away one entry (first cell, number) per shard and part and
    reads none. Parts are twice as wide each, back from the newest row: there are few, and what is left of one that the watermark has
    reached is cut anew. What ``take_all`` keeps is one more entry; it is asked again when the watermark has passed the time it names."""

    def take_all(self, rows: pa.Table, held: pa.Table | None, passed: int) -> tuple[pd.DataFrame | None, pa.Table | None, int]:
        """``held``: what was kept before; ``rows`` (key, t, known, id, kind): all not yet taken before ``passed`` (microseconds), later ones
        are not. Returns the output, what to keep, and the time up to which that matters; once passed, it is dropped."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell long, part long", "rows binary")
        self.parts = handle.getValueState("parts", "parts long")
        self.held = handle.getValueState("held", "until long, held binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, first = [], None
        for pdf in rows:
            t = pdf["t"].to_numpy().astype("datetime64[us]").astype("int64")
            waiting.append(pa.table({
                "key": pa.Array.from_pandas(pdf["key"]), "t": pa.array(t), "known": pa.array(pdf["known"].to_numpy(bool)),
                "id": pa.array(pdf["id"].to_numpy("int64")), "kind": pa.array(pdf["kind"].to_numpy().astype("uint8"))}))
            first = int(t.min()) if first is None else min(first, int(t.min()))
            if sum(x.num_rows for x in waiting) >= CHUNK_ROWS:
                self._put(pa.concat_tables(waiting))
                waiting = []
        if waiting:
            self._put(pa.concat_tables(waiting))
        if first is not None:
            self._wake(first // CELL_US)
        yield from ()

    def _wake(self, cell: int) -> None:
        self.handle.registerTimer((cell + 1) * CELL_US // 1000)

    def _put(self, rows: pa.Table) -> None:
        rows = rows.sort_by("t")
        t = rows.column("t").to_numpy()
        width = np.frexp((t[-1] - t) / PART_US + 1)[1]
        begin = np.flatnonzero(np.r_[True, width[1:] != width[:-1]]).tolist()
        part = int(self.parts.get()[0]) if self.parts.exists() else 0
        for lo, hi in zip(begin, [*begin[1:], len(t)]):
            self.cells.updateValue((int(t[lo]) // CELL_US, part), (_written(rows.slice(lo, hi - lo)),))
            part += 1
        self.parts.update((part,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // CELL_US * CELL_US  # cells are taken whole
        entries = sorted((int(c), int(p)) for c, p in self.cells.keys())
        ready = [(c, p) for c, p in entries if (c + 1) * CELL_US <= passed]
        until, held = (int(self.held.get()[0]), _read(bytes(self.held.get()[1]))) if self.held.exists() else (LONG_AGO, None)
        if not ready and (held is None or until > passed):
            return  # another timer of this shard has done it
        starts = [c for c, _ in entries[len(ready):]]
        waiting: list[pa.Table] = []
        for i, at in enumerate(ready):
            waiting.append(_read(bytes(self.cells.getValue(at)[0])))
            self.cells.removeKey(at)
            last = i + 1 == len(ready)
            if last or sum(x.num_rows for x in waiting) >= CHUNK_ROWS:
                edge = passed if last else ready[i + 1][0] * CELL_US  # no part that is still to be read has rows before
                rows = pa.concat_tables(waiting)
                before = rows.column("t").to_numpy() < edge
                waiting = [rows.filter(pa.array(~before))]
                out, held, until = self.take_all(rows.filter(pa.array(before)), held, edge)
                if out is not None and len(out):
                    yield out
        if not ready:
            held = None
        elif waiting[0].num_rows:
            self._put(waiting[0])
            starts.append(int(pc.min(waiting[0].column("t")).as_py()) // CELL_US)
        if held is not None and held.num_rows and until > passed:
            self.held.update((until, _written(held)))
            self._wake(until // CELL_US)
        else:
            self.held.clear()
        if starts:
            self._wake(min(starts))

    def close(self) -> None:
        pass


def in_rows(rows: pa.Table) -> np.ndarray:
    out = np.zeros(rows.num_rows, ROW)
    for c in ROW.names:
        out[c] = rows.column(c).to_numpy()
    return out


def ids(rows: np.ndarray) -> pd.api.extensions.ExtensionArray:
    """Ids of rows, NULL where they were."""
    return pd.arrays.IntegerArray(rows["id"].astype("int64"), ~rows["known"])


def stamps(t: np.ndarray) -> pd.DatetimeIndex:
    return pd.to_datetime(t, unit="us")
