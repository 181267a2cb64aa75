"""Collection of several sources, some of which cannot be read to their end."""

import pytest
from conftest import data
from pyspark.sql import types as T

from huntlake.session import scratch_path
from huntlake.sources.files import Files
from huntlake.sources.readers import Source
from huntlake.sources.staging import collect_staged

WIDE = T.StructType().add("id", "long").add("who", "string")


@pytest.fixture
def landing(spark):
    base = scratch_path(spark, "staging-test")
    spark.range(5).selectExpr("id", "concat('u', id) AS who").write.json(base + "/json")
    spark.range(7).selectExpr("id").write.parquet(base + "/part")
    # a folder in which one of two Parquet files is broken: some rows can be read before the read fails
    spark.range(3).selectExpr("id", "'x' AS who").coalesce(1).write.parquet(base + "/half")
    spark.createDataFrame([("not parquet",)], "value string").coalesce(1).write.mode("append").text(base + "/half")
    return base


def sources(base):
    return [Source("json", base + "/json", "json", WIDE), Source("half", base + "/half", "parquet", WIDE), Source("gone", base + "/gone", "csv", WIDE),
            Source("odd", base + "/json", "no such format"), Source("part", base + "/part", "parquet")]


def test_others_go_on(spark, landing):
    merged, report = collect_staged(spark, sources(landing), landing + "/stage", at_once=3)
    status = {r.source: (r.status, r.n) for r in report.collect()}
    assert status == {"json": ("ok", 5), "part": ("ok", 7), "half": ("failed", 0), "gone": ("failed", 0), "odd": ("failed", 0)}
    assert all((r.error is None) == (r.status == "ok") for r in report.collect())
    assert "not parquet" not in str(report.collect())
    rows = merged.select("collected_from", "id", "who").collect()
    assert sorted(r.id for r in rows if r.collected_from == "json") == list(range(5))
    assert sorted(r.id for r in rows if r.collected_from == "part") == list(range(7)) and len(rows) == 12
    # nothing of a source that failed stays
    assert [n for n in Files(spark).names(landing + "/stage") if not n.endswith(".crc")] == ["json", "json.json", "part", "part.json"]


def test_complete_sources_are_not_read_again(spark, landing):
    first, _ = collect_staged(spark, sources(landing), landing + "/stage")
    before = data(first)
    spark.range(100, 120).selectExpr("id", "'new' AS who").write.mode("append").json(landing + "/json")
    Files(spark).delete(landing + "/half")
    spark.range(2).selectExpr("id", "'mended' AS who").write.parquet(landing + "/half")
    again, report = collect_staged(spark, sources(landing), landing + "/stage")
    assert {r.source: r.n for r in report.collect() if r.status == "ok"} == {"json": 5, "part": 7, "half": 2}
    assert [r for r in data(again) if "mended" not in r] == before and again.count() == 14


def test_nothing_can_be_read(spark, landing):
    merged, report = collect_staged(spark, [sources(landing)[2]], landing + "/stage")
    assert merged is None and report.first().status == "failed"
    with pytest.raises(ValueError):
        collect_staged(spark, [sources(landing)[0]] * 2, landing + "/stage")
