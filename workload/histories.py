"""Stored histories: append, newest rows per monitor, newest profile per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.session import shared_dir
from tablewatch.sources.history import append, latest_n, latest_profile

from .common import r, stamp, table
from .monitor_checks import VOLUME_BY_TYPE_SQL, event_history


def _latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_n(event_history(spark, sf_dir), 7).select(
        "monitor_id", r("score").alias("score"), r("threshold").alias("threshold"), stamp("checked_at").alias("checked_at"),
        F.col("recency").cast("bigint").alias("recency"),
    )


_LATEST_N_SQL = f"""
SELECT monitor_id, score, threshold, ts AS checked_at, recency FROM (
  SELECT *, row_number() OVER (PARTITION BY monitor_id ORDER BY ts DESC) AS recency FROM ({VOLUME_BY_TYPE_SQL}))
WHERE recency <= 7"""


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appended runs, read back as one table."""
    path = shared_dir(spark, "history")
    runs = event_history(spark, sf_dir)
    for run in ("first", "second"):
        append(runs.withColumn("run", F.lit(run)), path, ["run"])
    return spark.read.parquet(path).groupBy("run", "monitor_id").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("score")).alias("score")
    )


_APPEND_SQL = f"""
SELECT run, monitor_id, count(*) AS n, round(sum(score), 6) AS score
FROM ({VOLUME_BY_TYPE_SQL}), (VALUES ('first'), ('second')) t(run) GROUP BY ALL"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly profile rows of order prices: status stands for the table, priority for the column."""
    return table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("table_name"), F.col("o_orderpriority").alias("column_name"),
        F.date_trunc("year", "o_orderdate").cast("timestamp").alias("profiled_at"),
    ).agg(F.count(F.lit(1)).alias("row_count"), F.avg("o_totalprice").alias("mean_val"))


def _latest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_profile(_profiles(spark, sf_dir)).select(
        "table_name", "column_name", "row_count", r("mean_val", 3).alias("mean_val"), stamp("profiled_at").alias("profiled_at")
    )


_LATEST_PROFILE_SQL = """
SELECT table_name, column_name, row_count, round(mean_val, 3) AS mean_val,
  strftime(profiled_at, '%Y-%m-%d %H:%M:%S') AS profiled_at FROM (
  SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY profiled_at DESC) AS rn FROM (
    SELECT o_orderstatus AS table_name, o_orderpriority AS column_name, date_trunc('year', o_orderdate) AS profiled_at,
      count(*) AS row_count, avg(o_totalprice) AS mean_val FROM orders GROUP BY 1, 2, 3)) WHERE rn = 1"""

QUERIES = {"history_latest_n": _latest_n, "history_append": _append, "latest_profile": _latest_profile}
ORACLE = {
    "history_latest_n": _LATEST_N_SQL,
    "history_append": _APPEND_SQL,
    "latest_profile": _LATEST_PROFILE_SQL,
}
