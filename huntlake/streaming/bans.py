"""Live bans in event-time order."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from huntlake.streaming.inorder import LONG_AGO, InOrder, ids, in_rows, sharded, stamps, use_rocksdb
from huntlake.streaming.live import event_time


def bans_in(t: np.ndarray, maxretry: int, find_us: int, ban_us: int) -> tuple[list[int], int]:
    """Of failures in time order: which open a ban, and from which on counting is still going."""
    m, start, found = maxretry - 1, 0, []
    full = np.flatnonzero(t[m:] - t[: max(len(t) - m, 0)] <= find_us) + m
    while True:
        at = np.searchsorted(full, start + m)
        if at == len(full):
            return found, start
        found.append(int(full[at]))
        start = int(np.searchsorted(t, t[full[at]] + ban_us, side="left"))


class Bans(InOrder):
    """Kept per source: the end of the last ban, and at most ``maxretry - 1`` failures after it."""

    def __init__(self, source: str, ts: str, event_id: str, maxretry: int, findtime: int, bantime: int):
        self.source, self.event_id, self.maxretry = source, event_id, maxretry
        self.find_us, self.ban_us = findtime * 1_000_000, bantime * 1_000_000

    def take_all(self, rows, held, passed):
        kept = {} if held is None else {k: (u, h) for k, u, h in zip(*(held.column(c).to_pylist() for c in ("key", "until", "held")))}
        coded, values = rows.column("key").combine_chunks().dictionary_encode(), in_rows(rows)
        code, outs = coded.indices.to_numpy(), []
        order = np.lexsort((values["id"], values["known"], values["t"], code))
        code, values = code[order], values[order]
        edges = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)] if len(code) else [0]
        names = coded.dictionary.to_pylist()
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = names[code[lo]]
            out, left, until = self.take((key,), kept.get(key, (0, b""))[1], values[lo:hi], passed)
            kept[key] = (until, left)
            outs += [] if out is None else [out]
        kept = {k: x for k, x in kept.items() if x[0] > passed}
        held = pa.table({"key": pa.array(kept, rows.schema.field("key").type), "until": pa.array([u for u, _ in kept.values()], pa.int64()),
                         "held": pa.array([h for _, h in kept.values()], pa.binary())})
        return pd.concat(outs) if outs else None, held, max((u for u, _ in kept.values()), default=LONG_AGO)

    def take(self, key, held, rows, passed):
        """The failures ``rows`` of one source, in time order: output, what to keep, and the time up to which that matters."""
        until, *recent = np.frombuffer(held, np.int64).tolist() if held else [LONG_AGO]
        rows = rows[rows["t"] >= until]
        t = np.r_[np.array(recent, np.int64), rows["t"]]
        found, start = bans_in(t, self.maxretry, self.find_us, self.ban_us)
        out = None
        if found:
            opened = rows[np.array(found) - len(recent)]  # never one of those kept: they were too few
            until = int(opened["t"][-1]) + self.ban_us
            out = pd.DataFrame({self.source: key[0], self.event_id: ids(opened), "ban_start": stamps(opened["t"]),
                                "ban_end": stamps(opened["t"] + self.ban_us)})
        recent = t[max(start, len(t) - self.maxretry + 1):].tolist()
        return out, np.array([until, *recent], np.int64).tobytes(), max([until, *[r + self.find_us for r in recent]])


def live_bans(df: DataFrame, source: str = "source_ip", ts: str = "ts", event_id: str = "event_id",
              maxretry: int = 5, findtime: int = 600, bantime: int = 3600) -> DataFrame:
    """Bans as they become certain, the same ones as ``ban_intervals`` finds in the finished table: rows that come late, but within the
    watermark, are put in their place first, over any number of micro-batches. A ban is reported when the watermark has
    passed the minute it starts in. Rows without source or time are left out."""
    use_rocksdb(df.sparkSession)
    failures = event_time(df.where(f"`{source}` IS NOT NULL AND `{ts}` IS NOT NULL"), ts)
    out = T.StructType([
        T.StructField(source, T.StringType()), T.StructField(event_id, T.LongType()),
        T.StructField("ban_start", T.TimestampType()), T.StructField("ban_end", T.TimestampType()),
    ])
    return sharded(failures, source, ts, event_id).transformWithStateInPandas(
        Bans(source, ts, event_id, maxretry, findtime, bantime), out, "append", "eventTime")
