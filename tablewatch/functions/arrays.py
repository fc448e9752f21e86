"""Robust statistics of a short, bounded array of scores, and learned thresholds.

The arrays hold at most one history window (20 scores by default), so they are
built by window frames or latest-N selections and never by collecting a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import bind, clamp

# Fixed value: scale factor that makes the MAD of a normal sample estimate sigma.
MAD_TO_SIGMA = 1.4826
# Fixed value: threshold floor used when there is no history at all.
EMPTY_HISTORY_FLOOR = 0.001


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(values).cast("double"))


def array_stddev_pop(values: Column) -> Column:
    def around(mean: Column) -> Column:
        squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        return F.sqrt(F.try_divide(squares, F.size(values).cast("double")))

    return bind(array_mean(values), around)


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    low = F.get(ordered, F.shiftright(n - 1, 1))
    high = F.get(ordered, F.shiftright(n, 1))
    return (low + high) / F.lit(2.0)


def array_median(values: Column) -> Column:
    return bind(F.array_sort(values), _middle)


def array_mad(values: Column) -> Column:
    return bind(
        array_median(values),
        lambda med: array_median(F.transform(values, lambda x: F.abs(x - med))),
    )


def _mad_limit(values: Column, k: float) -> Column:
    return array_median(values) + F.lit(k * MAD_TO_SIGMA) * array_mad(values)


def _sigma_limit(values: Column, k: float) -> Column:
    return array_mean(values) + F.lit(float(k)) * array_stddev_pop(values)


def _iqr_limit(values: Column, k: float) -> Column:
    def fences(ordered: Column) -> Column:
        n = F.size(ordered)
        at = lambda p: F.get(ordered, F.least(F.floor(n * F.lit(p)).cast("int"), n - 1))
        return at(0.75) + F.lit(float(k)) * (at(0.75) - at(0.25))

    return bind(F.array_sort(values), fences)


_LIMITS = {"mad": _mad_limit, "sigma": _sigma_limit, "iqr": _iqr_limit}


def auto_threshold(
    history: Column,
    method: str = "mad",
    sensitivity: float = 3.0,
    min_threshold: float = 0.001,
    max_threshold: float | None = None,
) -> Column:
    """Alert limit learned from an array of past scores.

    ``mad``: median + k * 1.4826 * MAD; ``sigma``: mean + k * population sigma;
    ``iqr``: q3 + k * (q3 - q1) with quartiles at index floor(n * p).
    The limit is clamped; an empty or null history gives max(min_threshold, 0.001).
    """
    if method not in _LIMITS:
        raise ValueError(f"unknown threshold method {method!r}")
    limit = clamp(_LIMITS[method](history, sensitivity), min_threshold, max_threshold)
    empty = F.lit(max(float(min_threshold), EMPTY_HISTORY_FLOOR))
    return F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, empty).otherwise(limit)


def modified_zscore_of(value: Column, history: Column) -> Column:
    """0.6745 * (value - median) / MAD against an array; 0 when MAD is 0 or the array empty."""
    score = F.try_divide(F.lit(0.6745) * (value - array_median(history)), array_mad(history))
    return F.coalesce(score, F.lit(0.0))
