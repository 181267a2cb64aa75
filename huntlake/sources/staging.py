"""Collection that goes on when a source fails while it is being read.

Every source is written to a folder of its own first; a note beside it says that it is complete, with its schema and row count. Only
complete sources are merged. A second call for the same stage reads only what has no note yet, so a collection that was
interrupted goes on where it stopped and no source is collected twice.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from huntlake.plans.sizes import local_rows
from huntlake.sources.files import Files
from huntlake.sources.readers import Source, read_source


def _name_of(error: Exception) -> str:
    """What went wrong, without any content of the source."""
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return condition or type(error).__name__


def _stage(spark: SparkSession, source: Source, stage: str) -> tuple[str, str, int, str | None]:
    files, path, note = Files(spark), f"{stage}/{source.name}", f"{stage}/{source.name}.json"
    if files.exists(note):
        return source.name, "ok", files.read_note(note)["rows"], None
    try:
        seen = Observation()
        df = read_source(spark, source).withColumn("collected_from", F.lit(source.name))
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
        rows = seen.get["rows"]
        files.write_note(note, {"rows": rows, "schema": df.schema.json()})
        return source.name, "ok", rows, None
    except (PySparkException, Py4JJavaError, ValueError, OSError) as error:
        files.delete(path)
        return source.name, "failed", 0, _name_of(error)


def collect_staged(spark: SparkSession, sources: Sequence[Source], stage: str, at_once: int = 4) -> tuple[DataFrame | None, DataFrame]:
    """All sources that could be read to their end as one frame with ``collected_from`` (None when there is none), and a status
    row per source: (source, status, n, error). Up to ``at_once`` sources are read at the same time. Source names are folder
    names and must differ."""
    if len({s.name for s in sources}) < len(sources):
        raise ValueError("two sources have the same name")
    stage = stage.rstrip("/")
    with ThreadPoolExecutor(max(1, min(at_once, len(sources)))) as pool:
        status = list(pool.map(inheritable_thread_target(spark)(lambda s: _stage(spark, s, stage)), sources))
    files, merged = Files(spark), None
    for name, state, _, _ in status:
        if state == "ok":
            schema = StructType.fromJson(json.loads(files.read_note(f"{stage}/{name}.json")["schema"]))
            part = spark.read.schema(schema).parquet(f"{stage}/{name}")
            merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged, local_rows(spark, status, "source string, status string, n long, error string")  # one row per source
