"""Times the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then three times; its time is the median, and includes
building the query, since some operators run jobs while they plan. BENCH_QUERIES picks a subset.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from huntlake.session import build_session
from huntlake.suite import QUERIES

HEADLINE = """
hunt_like hunt_window recent_events allowlist_semi latest_per_group hourly_profile resample_hourly top_sources
events_by_user user_profile describe_stats histogram baseline_zscore behavior_gaps user_sessions burst_detect
ban_intervals first_seen correlate_interval attack_map ioc_match enrich_source user_features mask_record pii_scan
secret_scan pii_profile mapping_new deanonymize dq_validate dq_profile normalize pii_flag audit_parse scan_json
reconcile_tables retention_report policy_resolve status_diff stream_tumbling
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark = build_session("huntlake-bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
