"""Null-safe numeric expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(column: Column | str) -> Column:
    """Widen to double; NaN becomes null, so it never takes part in a comparison."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def ratio(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """Division that yields ``default`` (or null) on a zero denominator."""
    q = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def clamp(value: Column, low: float | None, high: float | None) -> Column:
    """Limit to [low, high]; a null value stays null."""
    out = value
    if low is not None:
        out = F.when(out.isNotNull(), F.greatest(out, F.lit(float(low))))
    if high is not None:
        out = F.when(out.isNotNull(), F.least(out, F.lit(float(high))))
    return out


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a let binding in Catalyst)."""
    return F.get(F.transform(F.array(value), body), 0)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)
