"""Tables and queries of a JDBC database."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed value: accepted identifier, 1 to 63 word characters or dollar signs.
IDENTIFIER = re.compile(r"[\w$]{1,63}")


def checked_identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"Invalid SQL identifier: {name}")
    return name


@dataclass(frozen=True)
class Split:
    """Numeric or date column and bounds that cut a table into parallel reads."""

    column: str
    lower: str | int
    upper: str | int
    partitions: int


@dataclass(frozen=True)
class JdbcSource:
    url: str
    properties: Mapping[str, str]
    fetch_size: int = 10_000

    def options(self, schema: str, table: str, split: Split | None = None) -> dict[str, str]:
        name = f'"{checked_identifier(schema)}"."{checked_identifier(table)}"'
        out = {"url": self.url, "dbtable": name, "fetchsize": str(self.fetch_size), **self.properties}
        if split is not None:
            out |= {
                "partitionColumn": checked_identifier(split.column),
                "lowerBound": str(split.lower),
                "upperBound": str(split.upper),
                "numPartitions": str(split.partitions),
            }
        return out

    def table(
        self,
        spark: SparkSession,
        table: str,
        schema: str = "public",
        limit: int | None = None,
        split: Split | None = None,
    ) -> DataFrame:
        """A table with its own column names; filters, columns and limit are pushed down."""
        df = spark.read.format("jdbc").options(**self.options(schema, table, split)).load()
        return df if limit is None else df.limit(limit)

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        options = {"url": self.url, "query": sql, **self.properties}
        return spark.read.format("jdbc").options(**options).load()
