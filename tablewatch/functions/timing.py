"""Instants. Source tables may carry TIMESTAMP_NTZ; arithmetic is done on UTC instants."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("timestamp")


def literal_instant(value: datetime | str | Column) -> Column:
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds, truncated toward zero."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return (micros / F.lit(1_000_000)).cast("bigint")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
