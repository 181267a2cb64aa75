"""Clean-up of all stored tables, safe against being killed at any moment.

A run first prepares everything aside: it counts what is too old and writes the rows to keep of the cutoff day anew. Then it writes
a note of all intended moves into the journal, in one step. From then on the run is decided: moves are renames, each can be told
done or not done by looking, and the next run finishes what a killed one left. Before the note nothing
of any table was touched, and the next run removes what lies aside.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.operators.retention import expired, kept
from huntlake.plans.sizes import local_rows
from huntlake.schema import CLEANUP_LOG
from huntlake.sources.files import Files


@dataclass(frozen=True)
class StoredTable:
    """A Parquet table in one folder per day, and how long its rows are kept."""

    name: str
    path: str
    days: int
    ts: str = "timestamp"
    partition: str = "event_date"


def _planned(spark: SparkSession, files: Files, table: StoredTable, as_of: datetime, aside: str) -> dict:
    """What is to be moved for one table, and how many rows that removes. Rows to keep of the cutoff day are written under ``aside``."""
    cutoff = as_of - timedelta(days=table.days)
    root, mark = table.path.rstrip("/"), f"{table.partition}="
    days = [n.removeprefix(mark) for n in files.names(root) if n.startswith(mark)]
    old = [d for d in days if d[:10] < cutoff.date().isoformat() and d[:1].isdigit()]
    rows = spark.read.parquet(root)
    gone = rows.where(F.col(table.partition) < F.lit(cutoff.date())).count() if old else 0
    plan = {"table": table.name, "days": table.days, "drop": [[f"{root}/{mark}{d}", f"{aside}/gone/{mark}{d}"] for d in old], "out": [], "in": []}
    edge = f"{root}/{mark}{cutoff.date().isoformat()}"
    names = [n for n in files.names(edge) if not n.startswith(("_", "."))]
    if names:
        # these files and no others: what is appended meanwhile is neither read nor moved
        day = spark.read.schema(rows.drop(table.partition).schema).parquet(*[f"{edge}/{n}" for n in names])
        n_old = day.where(expired(table.ts, as_of, table.days)).count()
        if n_old:
            gone += n_old
            day.where(kept(table.ts, as_of, table.days)).write.mode("overwrite").parquet(f"{aside}/edge")
            plan["out"] = [[f"{edge}/{n}", f"{aside}/replaced/{n}"] for n in names]
            plan["in"] = [[f"{aside}/edge/{n}", f"{edge}/{n}"] for n in files.names(f"{aside}/edge") if n.startswith("part-")]
    return plan | {"rows": gone}


def _apply(files: Files, note: dict) -> None:
    """Moves that are not done yet. A file or folder is in one place or the other, so what to do can be seen."""
    for plan in note["plans"]:
        for source, target in plan["drop"]:
            if files.exists(source) and not files.exists(target):
                files.move(source, target)
        # old files go first: a reader in between misses rows of the cutoff day, but none twice; journal and table agree at the end
        for source, target in plan["out"] + plan["in"]:
            if files.exists(source) and not files.exists(target):
                files.move(source, target)


def _finish(spark: SparkSession, files: Files, journal: str, run: str, log_path: str) -> None:
    note = files.read_note(f"{journal}/{run}.json")
    _apply(files, note)
    rows = [(p["table"], p["rows"], datetime.fromisoformat(note["as_of"]), p["days"]) for p in note["plans"]]
    # a run is a partition of the log, so logging it twice changes nothing; one row per table
    local_rows(spark, rows, CLEANUP_LOG).coalesce(1).write.mode("overwrite").parquet(f"{log_path}/run_id={run}")
    files.delete(f"{journal}/{run}")
    files.delete(f"{journal}/{run}.json")


def recover(spark: SparkSession, journal: str, log_path: str) -> list[str]:
    """Finish runs that were decided, undo those that were not. Returns the runs finished."""
    files, names = Files(spark), Files(spark).names(journal)
    decided = [n.removesuffix(".json") for n in names if n.endswith(".json")]
    for run in decided:
        _finish(spark, files, journal, run, log_path)
    for name in names:
        if not name.endswith(".json") and name not in decided:
            files.delete(f"{journal}/{name}")
    return decided


def cleanup_job(spark: SparkSession, tables: Sequence[StoredTable], as_of: datetime, journal: str, log_path: str) -> DataFrame:
    """Remove the rows older than each table's period from all ``tables``; returns the log rows of this run, read back: one per
    table, also when nothing was removed. Rows without a time stay. One clean-up may run at a time; writers may go on
    appending. ``journal`` must be in the same store as the tables."""
    files, run = Files(spark), f"{as_of:%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
    recover(spark, journal, log_path)
    plans = [_planned(spark, files, t, as_of, f"{journal}/{run}/{t.name}") for t in tables]
    files.write_note(f"{journal}/{run}.json", {"as_of": as_of.isoformat(), "plans": plans})
    _finish(spark, files, journal, run, log_path)
    for t in tables:
        spark.catalog.refreshByPath(t.path)
    return spark.read.schema(CLEANUP_LOG).parquet(f"{log_path}/run_id={run}")


def cleanup_history(spark: SparkSession, log_path: str) -> DataFrame:
    """All runs: the log with ``run_id``, only rows where something was removed."""
    schema = T.StructType([*CLEANUP_LOG.fields, T.StructField("run_id", T.StringType())])
    return spark.read.schema(schema).parquet(log_path).where("rows_deleted > 0")
