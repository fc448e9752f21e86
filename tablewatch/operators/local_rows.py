"""Small constant tables (configuration, plan-time results) as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def constant_struct(fields: Sequence[T.StructField], row: Sequence[Any]) -> Column:
    return F.struct(
        *[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(fields, row, strict=True)]
    )


def constant_rows(spark: SparkSession, schema: str, rows: Sequence[Sequence[Any]]) -> DataFrame:
    """A DataFrame of literal rows; ``schema`` is a DDL string."""
    fields = T.StructType.fromDDL(schema).fields
    if not rows:
        return spark.createDataFrame([], T.StructType(fields))
    structs = [constant_struct(fields, r) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
