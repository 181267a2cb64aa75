"""Run registered queries next to their SQL in DuckDB and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, decimal.Decimal)):
        return ("n", int(v)) if v == int(v) else ("f", float(v))
    if isinstance(v, float):
        return ("f", v)
    if isinstance(v, datetime.datetime):
        return ("t", v.isoformat(sep=" "))
    return (type(v).__name__, v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def kinds(spark_types, duck_types):
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
            "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}
    return {n: (t, duck_types.get(n)) for n, t in spark_types.items() if same.get(t) != duck_types.get(n)}


def compare(con, df, sql):
    """None when equal, else a short text."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    odd = kinds(dict(df.dtypes), duck_types)
    if odd:
        return f"types differ: {odd}"
    if got != want:
        there, here = set(want), set(got)
        a, b = [r for r in got if r not in there][:3], [r for r in want if r not in here][:3]
        return f"{len(got)} rows against {len(want)}; only here {a}; only there {b}"
    return None if got else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from huntlake.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    if os.environ.get("PLAIN"):  # a session without the library's settings
        from pyspark.sql import SparkSession
        SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "America/New_York") \
            .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark = SparkSession.builder.getOrCreate() if os.environ.get("PLAIN") else build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    wanted = sys.argv[1:]
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            if name in sqls:
                res = compare(con, fn(spark, sf_dir), sqls[name])
            else:
                res = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as exc:
            res = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += res is not None
        print(f"{'FAIL' if res else 'ok  '} {name} {time.time() - t:.1f}s {res or ''}", flush=True)
    print("failed:", bad)
