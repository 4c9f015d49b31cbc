"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from shopgrain.registry.catalog import QUERIES
from shopgrain.session import local_session

HEADLINE = [
    "customer_features", "clean_transactions", "dedup_keep_first", "sanity_checks", "redact_pii", "monthly_revenue_yoy", "weekly_revenue",
    "category_perf", "region_perf", "discount_customers", "rfm_segments", "cohort_cells", "segment_ltv", "fraud_features", "velocity", "rule_scores",
    "cutoff_features", "kruskal_category", "mannwhitney_discount", "iqr_outliers", "kmeans_segments", "isolation_forest", "forecast_grid",
    "lof", "composite_risk",
]
#: Queries that took less than so many seconds run three times; their median counts.
REPEAT_BELOW = 5.0


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["category_perf"](spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM code paths
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    times = {}
    for name in names:
        taken = []
        while not taken or (len(taken) < 3 and taken[0] < REPEAT_BELOW):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.time() - start)
        times[name] = round(median(taken), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
