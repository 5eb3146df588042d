"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores. Each query is
planned and executed in full into the no-op sink; fitted constants are part of the measured time.
"""

from __future__ import annotations

import json
import os
import sys
import time

from auditspark.queries import ALL_QUERIES
from auditspark.session import build_session

HEADLINE = [
    "column_profile_lineitem", "profile_documents", "association_lineitem", "association_orders",
    "association_labelled", "discretize_orders", "medians_lineitem", "withhold_orders_counts",
    "pin_split_orders", "fold_counts_customer", "onehot_labelled", "auc_by_flag_lineitem",
    "regression_metrics_lineitem", "fingerprint_documents", "latest_dispositions_orders",
    "binding_objections_orders", "closure_counts_orders", "leakage_rates_orders",
    "node_seconds_events", "tally_events", "compare_events", "spend_cap_events",
    "stop_reason_events", "cell_tally_events", "cost_model_lineitem", "select_datasets",
    "loop_multiplier_events", "table_diff_orders", "ridge_lineitem",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("auditspark-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/region.parquet").count()  # start the executors before the clock
    times: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        ALL_QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
