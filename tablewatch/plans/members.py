"""Members of a set as values of a column's type.

A member is what its text or number means for the column: 1 and 1.0 are one member of a DOUBLE column, "2024-01-01"
is a member of a DATE column. A member that no value of the type can equal is never present.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


MOST_LITERALS = 1_000
MOST_BROADCAST = 1_000_000
# Types whose members mean the same as rows of a table.
_JOINED = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType, T.DateType)


@dataclass(frozen=True)
class Members:
    values: list  # distinct, of the column's type
    absent: list[str]  # as written
    dtype: T.DataType

    def __len__(self) -> int:
        return len(self.values) + len(self.absent)

    def literals(self) -> list[Column]:
        return [F.lit(v).cast(self.dtype) if not isinstance(v, Decimal) else F.lit(v) for v in self.values]

    def joins(self) -> bool:
        """Whether the set is better a table than literals of a plan."""
        return len(self.values) > MOST_LITERALS and isinstance(self.dtype, _JOINED)

    def table(self, spark: SparkSession) -> DataFrame:
        """The members as rows (``member``); broadcast up to ``MOST_BROADCAST`` of them, which the caller has listed himself."""
        rows = spark.createDataFrame([(v,) for v in self.values], T.StructType().add("member", self.dtype))
        return F.broadcast(rows) if len(self.values) <= MOST_BROADCAST else rows

    def outside(self, df: DataFrame, column: Column) -> DataFrame:
        """Rows with a value that is no member."""
        if not self.joins():
            return df.where(column.isNotNull() & ~self.holds(column))
        known = df.where(column.isNotNull())
        return known.join(self.table(df.sparkSession), column == F.col("member"), "left_anti")

    def holds(self, column: Column) -> Column:
        """Whether a value that is not null is a member; compared typed, so the scan can use it."""
        return column.isin(self.literals()) if self.values else F.lit(False)


def _number(value: object) -> Decimal | None:
    if isinstance(value, bool):
        return None
    try:
        return Decimal(str(value).strip())
    except InvalidOperation:
        return None


def _whole(value: object, bits: int) -> int | None:
    n = _number(value)
    if n is None or not n.is_finite() or n != n.to_integral_value():
        return None
    return int(n) if -(2 ** (bits - 1)) <= n < 2 ** (bits - 1) else None


def _text(value: object) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _parsed(value: object, kind: type) -> object | None:
    if isinstance(value, kind):
        return value
    try:
        return kind.fromisoformat(value) if isinstance(value, str) else None
    except ValueError:
        return None


_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _typed(value: object, dtype: T.DataType) -> object | None:
    if type(dtype) in _BITS:
        return _whole(value, _BITS[type(dtype)])
    if isinstance(dtype, T.FloatType | T.DoubleType):
        n = _number(value)
        return None if n is None else float(n)
    if isinstance(dtype, T.DecimalType):
        n = _number(value)
        return n if n is not None and n.is_finite() else None
    if isinstance(dtype, T.BooleanType):
        word = _text(value).strip().lower()
        return word == "true" if word in ("true", "false") else None
    if isinstance(dtype, T.DateType):
        return _parsed(value, datetime.date)
    if isinstance(dtype, T.TimestampType | T.TimestampNTZType):
        return _parsed(value, datetime.datetime)
    return _text(value)


def members_of(values: Iterable[object], dtype: T.DataType) -> Members:
    """Null is no member."""
    known: dict = {}
    absent: dict[str, None] = {}
    for value in values:
        if value is not None:
            typed = _typed(value, dtype)
            if typed is None:
                absent[_text(value)] = None
            else:
                known[typed] = None
    return Members(list(known), list(absent), dtype)
