"""Event-time volume and freshness metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import instant


def windowed_metrics(
    stream: DataFrame,
    ts_column: str = "ts",
    by: Sequence[str] = (),
    window: str = "1 hour",
    slide: str | None = None,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Rows (window_start, window_end, by..., row_count, newest), tumbling or sliding.

    Rows later than the watermark are dropped; a window is emitted once the watermark has
    passed its end. State holds one small row per open window and segment.
    """
    at = stream.withColumn("_at", instant(ts_column)).withWatermark("_at", watermark)
    frame = F.window("_at", window, slide) if slide else F.window("_at", window)
    return (
        at.groupBy(frame.alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("row_count"), F.max("_at").alias("newest"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
            "row_count", "newest",
        )
    )
