"""Outlier fences and z-scores of whole columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_double
from .order_stats import lower, select_ranks, upper


def interpolated_quantiles(df: DataFrame, value: str | Column, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbouring ranks."""
    v = as_double(value)
    wanted = {}
    for i, q in enumerate(probs):
        wanted[f"lo{i}"] = (q, lower(q))
        wanted[f"hi{i}"] = (q, upper(q))
    rows = select_ranks(df, {"v": v}, {"v": wanted}).collect()
    found = {r["name"]: r["value"] for r in rows}
    n = rows[0]["n"]
    out: list[float | None] = []
    for i, q in enumerate(probs):
        lo, hi = found[f"lo{i}"], found[f"hi{i}"]
        if lo is None:
            out.append(None)
            continue
        position = q * (n - 1)
        frac = position - int(position)
        out.append(lo if lo == hi else lo * (1.0 - frac) + hi * frac)
    return out


def iqr_outliers(df: DataFrame, value: str, multiplier: float = 1.5) -> DataFrame:
    """Rows of ``df`` outside [q1 - m * iqr, q3 + m * iqr], with the fences added.

    Input columns stay, so a key column takes the place of a row number.
    """
    q1, q3 = interpolated_quantiles(df, value, (0.25, 0.75))
    nothing = q1 is None or q3 is None
    low = None if nothing else q1 - multiplier * (q3 - q1)
    high = None if nothing else q3 + multiplier * (q3 - q1)
    v = as_double(value)
    number = lambda x: F.lit(x).cast("double")
    return df.where((v < number(low)) | (v > number(high))).withColumns(
        {"q1": number(q1), "q3": number(q3), "lower_fence": number(low), "upper_fence": number(high)}
    )


def with_zscore(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "zscore") -> DataFrame:
    """(x - mean) / sample stddev, over all rows or per key; 0 when that stddev is 0 or missing.

    Keys are aggregated first and joined back, so a large key is never gathered in one
    task; the join is planned by size and split by AQE when skewed.
    """
    v = as_double(value)
    stats = F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).alias("_stats")
    if by:
        out = df.join(df.groupBy(*by).agg(stats), list(by), "left")
        s = F.col("_stats")
    else:
        out = df.withColumn("_stats", df.agg(stats).scalar())
        s = F.col("_stats")
    z = F.coalesce(F.try_divide(v - s["mean"], s["sd"]), F.when(v.isNotNull(), F.lit(0.0)))
    return out.withColumn(name, z).drop("_stats")


def median_and_mad(df: DataFrame, value: str | Column) -> tuple[float | None, float | None]:
    """Exact median and median absolute deviation of a column."""
    (median,) = interpolated_quantiles(df, value, (0.5,))
    if median is None:
        return None, None
    v = value if isinstance(value, Column) else F.col(value)
    (mad,) = interpolated_quantiles(df, F.abs(as_double(v) - F.lit(median)), (0.5,))
    return median, mad


def with_modified_zscore(df: DataFrame, value: str, name: str = "modified_zscore") -> DataFrame:
    """0.6745 * (x - median) / MAD over all rows; 0 when MAD is 0."""
    median, mad = median_and_mad(df, value)
    v = as_double(value)
    if not mad:
        return df.withColumn(name, F.when(v.isNotNull(), F.lit(0.0)))
    return df.withColumn(name, F.lit(0.6745) * (v - F.lit(median)) / F.lit(mad))
