"""File and in-memory tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options: Any
) -> DataFrame:
    """CSV with a header line. Without a schema one extra pass infers it."""
    reader = spark.read.options(header=True, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def from_pandas(spark: SparkSession, frame: pd.DataFrame, schema: str | None = None) -> DataFrame:
    return spark.createDataFrame(frame, schema=schema)


def inline(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema=schema)


READERS = {"csv": read_csv, "parquet": read_parquet}


def open_table(spark: SparkSession, source_type: str, path: str, **options: Any) -> DataFrame:
    if source_type not in READERS:
        raise ValueError(f"unknown source type {source_type!r}; expected one of {sorted(READERS)}")
    return READERS[source_type](spark, path, **options)
