"""Result shapes shared by suites, monitors, profiles and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPECTATION_RESULTS = (
    "suite STRING, position INT, expectation STRING, column STRING, success BOOLEAN, "
    "observed DOUBLE, total BIGINT, min_value DOUBLE, max_value DOUBLE, "
    "observed_json STRING, expected_json STRING, exception STRING"
)
MONITOR_RESULTS = (
    "monitor_id STRING, monitor_type STRING, table_name STRING, alert BOOLEAN, severity STRING, "
    "score DOUBLE, threshold DOUBLE, message STRING, details MAP<STRING,STRING>, ts TIMESTAMP"
)
COLUMN_PROFILES = (
    "table_name STRING, column_name STRING, dtype STRING, row_count BIGINT, null_count BIGINT, "
    "distinct_count BIGINT, min_val DOUBLE, max_val DOUBLE, mean_val DOUBLE, stddev_val DOUBLE, "
    "quantiles ARRAY<DOUBLE>, profiled_at TIMESTAMP"
)
MONITOR_HISTORY = "monitor_id STRING, score DOUBLE, threshold DOUBLE, checked_at TIMESTAMP"

INFO, WARNING, CRITICAL = "INFO", "WARNING", "CRITICAL"


def severity_of(alert: Column, critical: Column) -> Column:
    return (
        F.when(alert & F.coalesce(critical, F.lit(False)), F.lit(CRITICAL))
        .when(alert, F.lit(WARNING))
        .otherwise(F.lit(INFO))
    )


def details(**entries: Column) -> Column:
    """MAP<STRING,STRING> of the non-null entries."""
    flat: list[Column] = []
    for key, value in entries.items():
        flat += [F.lit(key), value.cast("string")]
    return F.map_filter(F.create_map(*flat), lambda _k, v: v.isNotNull())


def detail_double(column: Column, key: str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(column, F.lit(key)).cast("double"), F.lit(float(default)))


def monitor_results(
    df: DataFrame,
    *,
    monitor_id: Column,
    monitor_type: str,
    table_name: Column | str,
    alert: Column,
    severity: Column,
    score: Column,
    threshold: Column,
    message: Column,
    details: Column,
    ts: Column,
) -> DataFrame:
    """Project ``df`` to the monitor-results shape."""
    table = F.lit(table_name) if isinstance(table_name, str) else table_name
    return df.select(
        monitor_id.cast("string").alias("monitor_id"),
        F.lit(monitor_type).alias("monitor_type"),
        table.alias("table_name"),
        F.coalesce(alert, F.lit(False)).alias("alert"),
        severity.alias("severity"),
        score.cast("double").alias("score"),
        threshold.cast("double").alias("threshold"),
        message.alias("message"),
        details.alias("details"),
        ts.cast("timestamp").alias("ts"),
    )
