"""Times the headline queries and prints one JSON line.

Stage tables are built first and timed on their own; a query that reads a stage is timed without
it, and a query over the given tables is timed as a whole. Every result is computed in full.
"""

from __future__ import annotations

import json
import os
import time

from catalog.queries import QUERIES
from catalog.stages import stages
from tenderlens.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

STAGES = ("facts", "statistics", "refreshed", "sample", "prepared", "clean")
HEADLINE = (
    "contract_label", "paid_by_reason", "sup_contract_count", "sup_avg_price",
    "sup_avg_penalty_share", "sup_stats", "org_stats", "okpd_stats", "sup_okpd_contracts",
    "sup_org_contracts", "federal_subject", "sup_similar_price_share",
    "org_similar_price_share", "sample_full", "incremental_append", "refresh_null_only",
    "rolled_up_rows", "flatten_contracts", "engineered_features", "clean_after_eda",
    "percentile_limits", "standardise", "woe_table", "woe_encode", "stratified_folds",
    "describe_numeric", "corr_matrix", "anova_f", "information_value", "histogram_clipped",
    "roc_auc", "roc_points", "classification_report", "calibration_curve", "quantile_grid",
    "sorted_series", "boosting_split_gains", "train_logistic", "train_forest", "train_gbt",
    "train_mlp",
)


def run(name: str, spark) -> float:
    start = time.time()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    spark = local_session(CPUS, "tenderlens-bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    built = stages(spark, FOLDER)
    for name in STAGES:
        start = time.time()
        getattr(built, name)
        times[f"stage_{name}"] = round(time.time() - start, 3)
    for name in HEADLINE:
        times[name] = round(run(name, spark), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
