"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up, then ``BENCH_REPS`` timed runs; the median
is reported (stored fits: their first run). Results are forced with the ``noop`` sink (full execution, no
collection to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "undervalued", "undervalued_all", "valuation_ratio", "neighborhood_ranking", "market_kpis",
    "describe", "correlation_matrix", "summary_stats", "box_stats_bedrooms", "price_outliers",
    "yearly_trend", "price_histogram", "auto_histogram", "price_density", "top_investments",
    "map_filter", "listing_search", "drop_duplicates", "impute_median", "event_type_counts",
    "recent_notifications", "endpoint_latency", "intent", "flatten_observation",
    "regression_metrics", "standardize", "scan_csv", "export_csv", "cross_validate_linear", "grade_price_bootstrap",
    "fit_boosted_a", "fit_boosted_b",
]
#: Fits are stored for the run, so a second one would only read the store: these are timed on their first run.
ONCE = {"fit_forest", "fit_boosted_a", "fit_boosted_b"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "2"))
    names = sys.argv[1:] or HEADLINE
    from hearth.plans.registry import QUERIES, load_all
    from hearth.session import build_session, remove_run
    load_all()
    spark = build_session(f"local[{cpus}]", "hearth-bench", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.driver.memory": "16g"})
    times = {}
    for n in names:
        def run():
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        if n not in ONCE:
            run()
        ts = []
        for _ in range(1 if n in ONCE else reps):
            t = time.perf_counter()
            run()
            ts.append(time.perf_counter() - t)
        times[n] = round(statistics.median(ts), 3)
        print(f"# {n}: {times[n]}s", file=sys.stderr, flush=True)
    remove_run(spark)
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
           "cpus": cpus, "reps": reps, "spark": spark.version,
           "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
