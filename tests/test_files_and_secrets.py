"""CSV by names and with line breaks, batch ids as text, and secrets that no plan shows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake import session as S
from huntlake.functions import masking as M
from huntlake.operators import privacy as P
from huntlake.session import scratch_path
from huntlake.sources import readers as R
from huntlake.sources import sinks as W

SALT, KEY = "a+salt(with|signs)", "fedcba9876543210fedcba9876543210"


def test_csv_values_come_back(spark):
    path = scratch_path(spark, "csv-test")
    rows = [(1, 'two\nlines, "quoted"\r\nand \\n'), (2, ""), (3, None), (4, '"'), (5, " x "), (6, "é ü")]
    df = spark.createDataFrame(rows, "id long, t string")
    W.write_result(df, path, "csv")
    got = R.scan_csv(spark, path, T.StructType().add("t", "string").add("id", "long"))
    assert got.columns == ["t", "id", "_corrupt"]
    back = got.collect()
    assert sorted((r.id, r.t) for r in back) == rows and not [r for r in back if r._corrupt is not None]


def test_csv_header_decides(spark, tmp_path):
    (tmp_path / "a.csv").write_text("who,id,more\nann,1,x\nbob,no number,y\n")
    schema = T.StructType().add("id", "long").add("who", "string").add("gone", "double")
    rows = R.scan_csv(spark, str(tmp_path), schema).collect()
    assert [(r.id, r.who, r.gone) for r in rows] == [(1, "ann", None), (None, "bob", None)]
    assert rows[0]._corrupt is None and rows[1]._corrupt.startswith("bob")
    assert R.scan_csv(spark, str(tmp_path), schema, multiline=False).count() == 2


def test_batches_are_told_apart_by_their_text(spark):
    path = scratch_path(spark, "batches")
    assert W.append_verify(spark.range(2), path, "1").first() == ("1", 2, 2, True)
    assert W.append_verify(spark.range(3), path, "001").first() == ("001", 3, 3, True)


def shown(df):
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return "".join(jvm.explainString(df._jdf.queryExecution(), mode) for mode in ("extended", "formatted", "simple"))


def test_no_plan_shows_salt_or_key(spark):
    df = spark.createDataFrame([("ann", "user")], "original string, field_type string")
    masked = df.select(M.mask_user(F.col("original"), SALT).alias("u"), M.mask_ip(F.col("original"), SALT, True).alias("i"))
    none = df.where("false").select(F.col("original").alias("anonymized_value"), "field_type")
    stored = P.new_mappings(df, none, SALT, KEY, "2024-01-01")
    back = stored.select(P.decrypt(F.col("original_value"), KEY).alias("v"))
    for plan in map(shown, (masked, stored, back)):
        assert "redacted" in plan
        for secret in (SALT, KEY):
            assert secret not in plan and secret.encode().hex() not in plan.lower()
    assert back.first().v == "ann"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        S.shared_dir(Session())
