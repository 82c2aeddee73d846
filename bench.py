"""Wall seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "panel_features", "rolling_sum", "rolling_distinct", "rolling_feature_grid", "quantile_bands", "percentile_rank",
    "agg_std", "agg_mode", "agg_spearman", "feature_synthesis", "attach_features", "frequency_encode", "impute_median",
    "scale_robust", "select_correlation", "select_anova_f", "stratified_split", "stratified_kfold", "class_balanced_bootstrap",
    "knn_join", "over_borderline_smote", "under_tomek", "test_spearman", "test_kendall", "test_mannwhitney", "test_levene",
    "tokenize_columns", "hashed_bow", "auc", "shard_by_key",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from panelspark.queries import QUERIES
    from panelspark.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for n in names:
        for into in (cold, warm):
            start = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            into[n] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, warm wall time", "value": round(sum(warm.values()), 3), "unit": "sec",
                "queries": warm, "cold": cold, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
