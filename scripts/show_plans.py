"""Summarise the physical plan of catalog queries: shuffles, broadcasts,
windows, generators, and for each parquet scan the columns read and the
filters pushed into it. Prints a Markdown table.

Usage: python scripts/show_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kilowatt.plans import catalog  # noqa: E402
from kilowatt.session import build_session  # noqa: E402

# trained queries: their DataFrame is a model's output, the work is the fit
SKIP = {"forest_forecast_metrics", "gbt_forecast_metrics", "leaf_budget_forecast_metrics", "best_params",
        "tree_dump", "kmeans_centers", "kmeans_silhouette", "text_quality_auc", "als_top_items", "topics",
        "pic_clusters", "isotonic_curve", "forest_classifier_metrics", "kmeans_text_vectors", "stream_kmeans",
        "panel_forecast_metrics", "user_daily_forecast_metrics", "indexed_gbt_forecast_metrics",
        "single_fit_metrics", "cv_results", "cv_closed_form", "ridge_one_feature", "stream_sentiment_by_source",
        "forest_random_split_metrics", "forecast_predictions", "logistic_two_rates", "cv_depth_grid", "cv_selection_metrics"}


def summary(plan: str) -> tuple[int, int, int, int, list[str]]:
    shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)",
                              plan))
    scans = []
    for m in re.finditer(r"FileScan parquet [^\n]*", plan):
        line = m.group(0)
        rs = re.search(r"ReadSchema: struct<([^>]*)", line)
        pf = re.search(r"PushedFilters: \[(.*?)(?:\]|\.\.\.,)", line)
        cols = ",".join(c.split(":")[0] for c in (rs.group(1).split(",") if rs else []))
        scans.append(f"{cols} / {pf.group(1) if pf and pf.group(1) else '-'}")
    return shuffles, plan.count("BroadcastExchange"), plan.count("Window "), plan.count("Generate "), scans


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or [n for n in catalog.queries() if n not in SKIP]
    spark = build_session("local[8]", shuffle_partitions=16)
    print("| query | shuffles | broadcasts | windows | generates | scans: columns read / pushed filters |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name in names:
        df = catalog.queries()[name](spark, sf_dir)
        s, b, w, g, scans = summary(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {s} | {b} | {w} | {g} | {'<br>'.join(scans) or '(checkpoint / local rows)'} |")


if __name__ == "__main__":
    main()
