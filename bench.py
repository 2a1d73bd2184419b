"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is materialised with the ``noop`` sink (full execution, nothing
collected): one warm-up run, then the median of ``BENCH_RUNS`` timed runs.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mercato.catalog import HEADLINE, QUERIES, q_models  # noqa: E402
from mercato.session import build_session  # noqa: E402

DEFAULT_QUERIES = HEADLINE + [
    "daily_totals", "forecast_linear_by_segment", "forecast_moving_average", "forecast_naive",
    "churn_at_risk_count", "impute_missing", "run_status_by_day", "latest_run_per_upload",
    "customer_features", "rule_churn_risk", "threshold_sweep", "roc_auc", "demand_features",
    "recent_predictions", "new_customers_only", "preprocess_document",
]

# the heaviest of the rest
HEAVY = ["churn_train_metrics", "demand_score", "stream_upload_insights", "insights_document",
         "labelled_gate", "upload_mixed_headers"]


def _sf_of(path: str) -> str:
    base = os.path.basename(os.path.normpath(path))
    return base[2:] if base.startswith("sf") else base


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or DEFAULT_QUERIES + HEAVY
    names = [n for n in dict.fromkeys(names) if n in QUERIES]
    spark = build_session(f"local[{cpus}]", app_name="mercato-bench",
                          shuffle_partitions=int(cpus) * 2,
                          extra_conf={"spark.driver.memory": "16g"})
    timings, errors = {}, {}
    for name in names:
        fn = QUERIES[name]
        try:
            samples = []
            for i in range(runs + 1):
                q_models._TRAINED.clear()          # a fit is measured, not remembered
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                if i:
                    samples.append(time.perf_counter() - t0)
            timings[name] = round(statistics.median(samples), 4)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    out = {"metric": "headline_queries_total_median_sec",
           "value": round(sum(timings.values()), 4), "unit": "sec", "queries": timings,
           "sf": _sf_of(sf_dir), "cpus": int(cpus), "runs": runs}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
