"""Benchmark the headline catalogue queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8) and prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed to completion through the ``noop`` sink (every
row computed, nothing collected).  Each is run ``$BENCH_RUNS`` times
(default 2) and the last, warm run is reported (JIT and code generation
caches filled by the first).  ``$BENCH_QUERIES`` (comma separated) limits
the set.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "features_all",        # load + every feature family (one stats job)
    "label_fallback",      # ensemble with constant anomaly + exact quantile
    "score_alerts",        # full ensemble: isolation forest fit + score + label
    "pattern_analysis",
    "fp_summary",
    "severity_distribution",
    "daily_trend",
    "top_fp",
    "roi",
    "global_row_index",
    "robust_scale",
    "ks_statistic",
    "correlation_pairs",
    "model_suite",
    "triage_all_reports",  # fit once, write labelled table once, all 15 report tables
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE

    from alertsieve.plans import catalog
    from alertsieve.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="alertsieve-bench")
    # the events file is one row group: ask for as many partitions as there are tasks at once
    spark.conf.set("alertsieve.scan.partitions", str(2 * int(cpus)) if cpus.isdigit() else "16")
    qs = catalog.queries()

    def features_all(s, d):
        return catalog.features(s, d)

    qs["features_all"] = features_all

    def triage_all_reports(s, d):
        from alertsieve.plans.triage import run_triage

        return list(run_triage(catalog.alerts(s, d))[2].values())

    qs["triage_all_reports"] = triage_all_reports

    def run(name: str) -> float:
        t0 = time.perf_counter()
        out = qs[name](spark, sf_dir)
        for df in (out if isinstance(out, list) else [out]):
            df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    runs = max(1, int(os.environ.get("BENCH_RUNS", "2")))
    run("duration_stats")  # starts the JVM side and the Python workers
    times = {}
    for name in names:
        for _ in range(runs):
            t = run(name)
        times[name] = round(t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else None}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
