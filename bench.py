"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (the whole plan
executes, nothing is collected) and is timed separately. After every query the
time so far goes to stderr; the last line on stdout is one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sigflow.plans import registry  # noqa: E402
from sigflow.session import local_session, ship_package  # noqa: E402

HEADLINE = [
    "ANA7_class_purity",      # flagship: exact k-NN + label purity
    "ANA8_cell_purity",       # per-cell k-NN
    "ANA3_intra_pairs",       # capped intra-label pair correlations
    "ANA4_null_sample",       # inter-label null sample
    "ANA5_full_study",        # 2 matrices x 2 correlations, medians
    "ANA9_enrichment",        # pre-ranked enrichment, hits-only walk
    "CHM3_tanimoto",          # all-pairs Tanimoto by inverted index
    "CHM4_clusters",          # grouped average-linkage clustering
    "ML4_ridge",              # Gram-matrix ridge, all targets
    "JN5_stats",              # id harmonisation
    "AGG8_coverage_stats",    # pathway coverage
    "FLT1_report",            # activity filter report
    "AGG19_value_histogram",  # whole-matrix histogram
    "WIN3_avg_rank",          # average ranks, long form
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="sigflow-bench")
    ship_package(spark)
    qs = registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()   # JVM warm-up
    times = {}
    for name in HEADLINE:
        if name not in qs:
            continue
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
        print(json.dumps({"query": name, "sec": times[name]}), file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
