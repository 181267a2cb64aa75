"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "huntlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; cluster sizing stays with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        # recording the call site of every Column costs more than building it
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # keys and salts are literals in masking plans; keep them out of logs and the UI
        "spark.sql.redaction.string.regex": "(?i)secret|salt|aes_(en|de)crypt|password",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_REDACTED = "spark.sql.redaction.string.regex"


def hide(*values: str) -> None:
    """Keep values that are literals of a plan (salts, keys) out of its text: explain, logs, event log and UI show
    ``*********(redacted)`` for them, as text or in hex. They are added to the pattern of the active session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    pattern = spark.conf.get(_REDACTED, "") or ""
    new = [form for v in values if v for form in (re.escape(v), v.encode().hex(), v.encode().hex().upper()) if form not in pattern]
    if new:
        spark.conf.set(_REDACTED, "|".join(filter(None, [pattern, *new])))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: the one the cluster names, else a new one for local tests. On a cluster a folder of one machine
    would not do, so there the setting must be made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="huntlake-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/huntlake/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives executor loss and is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
