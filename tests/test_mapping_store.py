"""Mappings are stored once; the stored side is neither shuffled nor read for values that are certainly new."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntlake.functions import masking as M
from huntlake.operators import privacy as P
from huntlake.session import scratch_path
from huntlake.sources import mapping_store as S

KEY, SALT = "0123456789abcdef0123456789abcdef", "salt"


@pytest.fixture
def store(spark):
    return S.MappingStore(spark, f"mappings_{uuid.uuid4().hex}", scratch_path(spark, "mappings-test"), buckets=16).create()


def values(spark, n, start=0):
    return spark.range(start, n).select(F.concat(F.lit("user"), "id").alias("original"), F.lit("user").alias("field_type"))


def stored(store):
    return sorted(r.v for r in store.read().select(P.decrypt(F.col("original_value"), KEY).alias("v")).collect())


def test_each_value_once(spark, store):
    first = values(spark, 300).unionByName(values(spark, 50)).unionByName(spark.createDataFrame([(None, "user")], "original string, field_type string"))
    assert store.add(first, SALT, KEY, "2024-01-01").first() == (300, 300)
    assert store.add(values(spark, 400, 100), SALT, KEY, "2024-01-02").first() == (300, 100)
    assert store.add(values(spark, 400), SALT, KEY, "2024-01-03").first() == (400, 0)
    assert stored(store) == sorted(f"user{i}" for i in range(400))
    assert len(store._versions()) == 1
    # another session finds table and filters by their path
    again = S.MappingStore(spark, f"other_{uuid.uuid4().hex}", store.path, buckets=16).create()
    assert again.add(values(spark, 410), SALT, KEY, "2024-01-04").first() == (410, 10)


def test_killed_between_filters_and_rows(spark, store, monkeypatch):
    store.add(values(spark, 100), SALT, KEY, "2024-01-01")
    real = S.encrypt
    monkeypatch.setattr(S, "encrypt", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.add(values(spark, 200), SALT, KEY, "2024-01-02")
    monkeypatch.setattr(S, "encrypt", real)
    assert store.add(values(spark, 200), SALT, KEY, "2024-01-02").first() == (200, 100)
    assert stored(store) == sorted(f"user{i}" for i in range(200))


def test_stored_side_is_not_shuffled(spark, store):
    store.add(values(spark, 200), SALT, KEY, "2024-01-01")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        masked = values(spark, 300).withColumn("anonymized_value", M.mask_user(F.col("original"), SALT))
        df = store.unknown(masked)
        plan = df._jdf.queryExecution().executedPlan().toString()
        scan = next(i for i, line in enumerate(plan.splitlines()) if "FileScan parquet" in line and store.name in line)
        above = plan.splitlines()[:scan]
        # from the stored scan up to the join that reads it stands no exchange, and the scan goes by buckets
        join = max(i for i, line in enumerate(above) if "Join" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-|*()0123456789"))
        chain = [plan.splitlines()[scan]]
        for line in reversed(above[join + 1:]):
            if depth(line) < depth(chain[-1]):
                chain.append(line)
        assert "Bucketed: true" in chain[0] and not [line for line in chain if "Exchange" in line]
        assert df.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_grow_and_forget_nothing():
    rng = np.random.default_rng(0)
    held, seen = S.Filter([]), np.empty(0, np.int64)
    for n in (1, 4095, 1, 10_000, 30_000):
        h = rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64)
        held.add(h)
        held = S.Filter(held.rows())  # as written and read back
        seen = np.r_[seen, h]
        assert held.knows(seen).all()
    assert len(held.layers) == 4 and sum(n for n, _ in held.rows()) == len(seen)
    assert held.knows(rng.integers(-2**63, 2**63 - 1, 20_000, dtype=np.int64)).mean() < 0.03
