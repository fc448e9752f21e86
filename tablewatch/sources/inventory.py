"""What tables there are, their columns and sizes, and timed queries."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.local_rows import constant_rows, union_all

INVENTORY = "table_name STRING, ordinal INT, column_name STRING, dtype STRING, nullable BOOLEAN"


def list_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows (table_name, ordinal, column_name, dtype, nullable) from the schemas, without a scan."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return constant_rows(spark, INVENTORY, rows)


def table_inventory(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``list_columns`` with the row count of each table."""
    counts = union_all(
        [df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
         for name, df in tables.items()]
    )
    # One row per table.
    return list_columns(spark, tables).join(F.broadcast(counts), "table_name")


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Every table and view of a catalog database by name."""
    out = {}
    for t in spark.catalog.listTables(database):
        place = [] if t.isTemporary else [t.catalog, *(t.namespace or [])]
        out[t.name] = spark.table(".".join(f"`{part}`" for part in [*place, t.name] if part))
    return out


@dataclass(frozen=True)
class QueryRun:
    row_count: int
    elapsed_ms: int


def execute_query(spark: SparkSession, sql: str) -> QueryRun:
    """Run a query for its row count and time; the rows stay on the executors."""
    started = time.monotonic()
    rows = spark.sql(sql).count()
    return QueryRun(rows, int((time.monotonic() - started) * 1000))
