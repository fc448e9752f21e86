"""Append-only result tables and reads of their newest entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: history rows returned per monitor unless asked otherwise.
LATEST_DEFAULT = 100


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def history_rows(results: DataFrame) -> DataFrame:
    """Monitor results as history entries (monitor_id, score, threshold, checked_at)."""
    return results.where("score IS NOT NULL").select(
        "monitor_id", "score", "threshold", F.col("ts").alias("checked_at")
    )


def latest_n(history: DataFrame, n: int = LATEST_DEFAULT, tie: Sequence[str] = ("score",)) -> DataFrame:
    """The newest ``n`` entries per monitor, with ``recency`` 1 for the newest.

    Spark limits every partition to n rows per monitor before the shuffle, so a monitor
    with a very long history sends n rows per task at most.
    """
    order = [F.col("checked_at").desc(), *[F.col(c).desc() for c in tie]]
    newest = Window.partitionBy("monitor_id").orderBy(*order)
    return history.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def recent_scores(history: DataFrame, n: int, before: Column | None = None) -> DataFrame:
    """Rows (monitor_id, scores): the newest ``n`` scores as an array, oldest first."""
    past = history if before is None else history.where(F.col("checked_at") < before)
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("recency")).alias("o"), "score")))
    return (
        latest_n(past, n)
        .groupBy("monitor_id")
        .agg(F.transform(ordered, lambda x: x["score"]).alias("scores"))
    )


def latest_profile(
    profiles: DataFrame, keys: Sequence[str] = ("table_name", "column_name")
) -> DataFrame:
    """The newest profile row per table and column (one partial maximum per task)."""
    values = [c for c in profiles.columns if c not in keys and c != "profiled_at"]
    newest = F.max_by(F.struct(*values, "profiled_at"), "profiled_at").alias("p")
    return profiles.groupBy(*keys).agg(newest).select(*keys, "p.*")
