"""Value counts, distinct counts, duplicates and key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def value_counts(df: DataFrame, columns: Sequence[str], count: str = "count") -> DataFrame:
    """Rows per distinct key; partial aggregation collapses frequent keys before the shuffle."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count))


def duplicate_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (total_rows, unique_values, duplicate_count, duplicate_ratio); null is a value."""
    total, unique = F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))
    return (
        value_counts(df, columns, "_n")
        .agg(total.alias("total_rows"), unique.alias("unique_values"))
        .select(
            "total_rows",
            "unique_values",
            (F.col("total_rows") - F.col("unique_values")).alias("duplicate_count"),
            ratio(F.col("total_rows") - F.col("unique_values"), F.col("total_rows"), 0.0).alias(
                "duplicate_ratio"
            ),
        )
    )


def orphan_keys(
    source: DataFrame, source_columns: Sequence[str], target: DataFrame, target_columns: Sequence[str]
) -> DataFrame:
    """Rows (key columns, _n): source keys missing from the target, with their row count.

    The source is reduced to one row per key first, so a key with very many rows costs one
    row in the join. Keys with a null are left out (they reference nothing).
    """
    present = [F.col(c).isNotNull() for c in source_columns]
    keys = source.select(*source_columns).where(_all(present))
    counted = value_counts(keys, source_columns, "_n")
    known = target.select(
        *[F.col(t).alias(f"_k{i}") for i, t in enumerate(target_columns)]
    ).distinct()
    match = _all([F.col(s) == F.col(f"_k{i}") for i, s in enumerate(source_columns)])
    return counted.join(known, match, "left_anti")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def top_k(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties broken by value; ordered (TakeOrdered, no full sort)."""
    return value_counts(df, [column]).orderBy(F.col("count").desc(), F.col(column).asc()).limit(k)
