"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution,
nothing collected). One warm-up pass, then the median of
``$BENCH_REPEATS`` timed runs per query. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kilowatt.plans import catalog  # noqa: E402
from kilowatt.session import build_session  # noqa: E402

HEADLINE = [
    "word_count",
    "text_scan_word_count",
    "tokenize_counts",
    "sentiment_by_source",
    "hourly_load",
    "lag_24_48",
    "asof_last_view",
    "persistence_metrics",
    "assemble_slots",
    "index_categories",
    "forest_stump",
    "gbt_stump",
    "cv_results",
    "auc_given_score",
    "silhouette_given_labels",
    "assign_given_centers",
    "kmeans_centers",
    "pagerank_5",
    "frequent_itemsets",
    "forest_forecast_metrics",
    "user_daily_forecast_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", app="kilowatt-bench", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    qs = catalog.queries()
    names = only or HEADLINE

    def run(name: str) -> float:
        t = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    for name in names[:3]:  # warm-up: JVM, code generation, file listing
        run(name)
    timings: dict[str, float] = {}
    for name in names:
        timings[name] = round(statistics.median(run(name) for _ in range(repeats)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeats": repeats,
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
