"""Live sequences: an event and the first one that follows it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.streaming.inorder import InOrder, ids, in_rows, sharded, stamps, use_rocksdb
from huntlake.streaming.live import event_time

IS_A, IS_B = 1, 2


class Followers(InOrder):
    """Kept per shard: first events that may still be followed."""

    def __init__(self, key: str, within_us: int):
        self.key, self.within_us = key, within_us

    def take_all(self, rows, held, passed):
        kind = rows.column("kind").to_numpy()
        a = rows.filter(pa.array(kind & IS_A > 0))
        a = a if held is None else pa.concat_tables([held, a])
        both = pa.concat_tables([a, rows.filter(pa.array(kind & IS_B > 0))]).combine_chunks()
        values, first = in_rows(both), np.arange(both.num_rows) < a.num_rows
        code = both.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        # of equal times B comes first, so the next B in this order is strictly later; of equal times the least id
        order = np.lexsort((values["id"], values["known"], first, values["t"], code))
        nothing = len(order)
        place = np.where(first[order], nothing, np.arange(nothing))
        then = np.minimum.accumulate(place[::-1])[::-1]
        is_a = first[order]
        a_at, b_place = order[is_a], then[is_a]
        hit = b_place < nothing
        b_at = order[b_place[hit]]
        hit[hit] = (code[b_at] == code[a_at[hit]]) & (values["t"][b_at] <= values["t"][a_at[hit]] + self.within_us)
        out = None
        if hit.any():
            a_hit, b_hit = a_at[hit], order[b_place[hit]]
            x, y = values[a_hit], values[b_hit]
            out = pd.DataFrame({self.key: both.column("key").take(pa.array(a_hit)).to_pandas(), "a_id": ids(x), "a_ts": stamps(x["t"]),
                                "b_id": ids(y), "b_ts": stamps(y["t"])})
        left = a_at[~hit]
        left = left[values["t"][left] + self.within_us > passed]
        until = int(values["t"][left].max()) + self.within_us if len(left) else passed
        return out, both.take(pa.array(left)), until


def live_sequence(df: DataFrame, is_a: Column, is_b: Column, key: str = "user_id", ts: str = "ts",
                  event_id: str = "event_id", within_seconds: int = 3600) -> DataFrame:
    """(key, a_id, a_ts, b_id, b_ts): A rows and the first B row of the same entity strictly later and at most ``within_seconds`` later,
    once the watermark has passed the minute of B. Entities are cut into time buckets as wide as the interval, B going to its own
    bucket and to the one before, so a busy entity spreads over shards."""
    use_rocksdb(df.sparkSession)
    kind = F.when(is_a, IS_A).otherwise(0) + F.when(is_b, IS_B).otherwise(0)
    bucket = F.floor(F.unix_seconds(F.col(ts)) / within_seconds)
    rows = event_time(df.where((is_a | is_b) & F.col(ts).isNotNull() & F.col(key).isNotNull()), ts)
    own = F.struct(bucket.alias("bucket"), kind.alias("kind"))
    before = F.when(kind >= IS_B, F.struct((bucket - 1).alias("bucket"), F.lit(IS_B).alias("kind")))
    rows = rows.select(key, ts, event_id, F.explode(F.array_compact(F.array(own, before))).alias("p")).select(
        key, "p.bucket", ts, event_id, F.col("p.kind").alias("kind"))
    out = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("a_id", T.LongType()), T.StructField("a_ts", T.TimestampType()),
        T.StructField("b_id", T.LongType()), T.StructField("b_ts", T.TimestampType()),
    ])
    return sharded(rows, key, ts, event_id, F.col("bucket"), kind=F.col("kind")).transformWithStateInPandas(
        Followers(key, within_seconds * 1_000_000), out, "append", "eventTime")
