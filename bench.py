"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.plans.registry import all_queries  # noqa: E402
from tablewright.session import build_session  # noqa: E402

HEADLINE = [
    "distribution_numeric", "distribution_histogram", "distribution_top_values", "correlation_pearson",
    "correlation_spearman", "missing_columns", "outliers_both", "outliers_extremes", "profile_columns",
    "suggest_columns", "split_random_sizes", "split_stratified_shares", "split_random_exact", "impute_mean",
    "impute_median", "encode_label", "encode_label_many", "encode_one_hot", "scale_standard", "scale_robust",
    "log_signed", "interact_ratio", "dates_parts", "select_correlation", "select_mutual_information",
    "curves_summary", "curves_roc", "confusion_cells", "classification_metrics", "regression_metrics",
    "comparison_binary", "linear_regression", "logistic_regression", "decision_tree", "random_forest",
    "gradient_boosting", "whole_job",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        found[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
