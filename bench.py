"""Time the headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

import workload

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = (
    "exp_contract", "suite_summary", "exp_unique", "exp_quantile", "exp_kl_divergence",
    "stat_ks", "stat_js", "stat_chi_square", "stat_iqr_outliers", "stat_zscore", "stat_pearson", "stat_spearman",
    "mon_freshness", "mon_volume", "mon_dist_ks", "mon_dist_js", "mon_uniqueness", "mon_referential", "mon_cost",
    "profile_table", "suggest_expectations", "history_latest_n", "hints_context", "dimension_isolation",
    "incident_register", "incident_dedup", "incident_state", "alert_payloads",
    "lineage_columns", "lineage_graph", "dbt_models", "airflow_events", "ge_translate", "stream_volume",
)


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("OFF")
    wanted = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        taken = []
        for i in range(RUNS + 1):  # the first run warms up
            started = time.perf_counter()
            workload.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
