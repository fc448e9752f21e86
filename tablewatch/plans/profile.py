"""Column profiles: one shared scan for the moments, value counts per column for distincts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_double, is_numeric
from ..functions.timing import literal_instant
from ..operators.distinct import top_k
from ..operators.histogram import histogram
from ..operators.local_rows import union_all
from ..operators.order_stats import nearest, select_ranks
from .suite import METRICS_PER_SCAN

# Quantiles kept in a profile.
PROFILE_QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_name, dtype, row_count, null_count, min_val, max_val, mean_val, stddev_val)."""
    rows, aggs, none = [], [F.count(F.lit(1)).alias("n")], F.lit(None).cast("double")
    for i, name in enumerate(columns):
        dtype = df.schema[name].dataType
        aggs.append(F.count_if(_q(name).isNull()).alias(f"nulls{i}"))
        stats = {k: none for k in ("min_val", "max_val", "mean_val", "stddev_val")}
        if is_numeric(dtype):
            v = as_double(_q(name))
            aggs += [
                F.min(v).alias(f"min{i}"),
                F.max(v).alias(f"max{i}"),
                F.avg(v).alias(f"mean{i}"),
                # A single value has spread 0.
                F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, F.lit(0.0))).alias(f"sd{i}"),
            ]
            stats = {
                "min_val": F.col(f"min{i}"),
                "max_val": F.col(f"max{i}"),
                "mean_val": F.col(f"mean{i}"),
                "stddev_val": F.col(f"sd{i}"),
            }
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(dtype.simpleString()).alias("dtype"),
                F.col("n").alias("row_count"),
                F.col(f"nulls{i}").alias("null_count"),
                *[v.alias(k) for k, v in stats.items()],
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _same_zero(df: DataFrame, name: str) -> Column:
    """The column with 0.0 for -0.0, which are equal but hash apart."""
    c = _q(name)
    floating = df.schema[name].dataType.typeName() in ("float", "double")
    return F.when(c == 0, F.lit(0.0)).otherwise(c) if floating else c


def _distinct_counts(df: DataFrame, columns: Sequence[str], rsd: float | None) -> DataFrame:
    if rsd is not None:
        wide = df.agg(
            *[
                (F.approx_count_distinct(_q(c), rsd) + F.max(_q(c).isNull().cast("int"))).alias(f"d{i}")
                for i, c in enumerate(columns)
            ]
        )
        rows = [
            F.struct(F.lit(c).alias("column_name"), F.col(f"d{i}").cast("bigint").alias("distinct_count"))
            for i, c in enumerate(columns)
        ]
        return wide.select(F.inline(F.array(*rows)))
    # Every value of every column as (column, 128 bits of hash): one scan, and one exchange of what
    # partial aggregation leaves of it. Null is one value more.
    cells = [
        F.struct(F.lit(i).alias("i"), F.xxhash64(v).alias("h"), F.xxhash64(F.lit(1), v).alias("g"), v.isNull().alias("missing"))
        for i, v in enumerate(_same_zero(df, c) for c in columns)
    ]
    values = df.select(F.inline(F.array(*cells))).groupBy("i", "h", "g", "missing").agg(F.lit(1).alias("one"))
    names = F.array(*(F.lit(c) for c in columns))
    return values.groupBy("i").agg(F.count(F.lit(1)).alias("distinct_count")).select(
        F.get(names, F.col("i")).alias("column_name"), "distinct_count"
    )


def profile(
    df: DataFrame,
    table_name: str,
    profiled_at: datetime | str | Column | None = None,
    columns: Sequence[str] | None = None,
    approx_distinct: float | None = None,
) -> DataFrame:
    """One row per column in the shape of ``results.COLUMN_PROFILES``.

    Null counts as one distinct value. Quantiles are exact nearest-rank values.
    ``approx_distinct`` takes distinct counts from a sketch with that relative deviation,
    in one scan instead of one value count per column.
    """
    names = list(columns or df.columns)
    numeric = [c for c in names if is_numeric(df.schema[c].dataType)]
    per_scan = METRICS_PER_SCAN // 5
    moments = union_all(
        [_moments(df, names[i : i + per_scan]) for i in range(0, len(names), per_scan)]
    )
    distinct = _distinct_counts(df, names, approx_distinct)
    # Everything joined below has one row per column of the table.
    out = moments.join(F.broadcast(distinct), "column_name", "left")
    if numeric:
        ranks = select_ranks(
            df,
            {c: as_double(_q(c)) for c in numeric},
            {c: {str(i): (q, nearest(q)) for i, q in enumerate(PROFILE_QUANTILES)} for c in numeric},
        )
        quantiles = ranks.groupBy(F.col("label").alias("column_name")).agg(
            F.sort_array(F.collect_list(F.struct("name", "value"))).alias("q")
        )
        quantiles = quantiles.select(
            "column_name",
            F.when(
                F.get("q", F.lit(0))["value"].isNotNull(), F.transform("q", lambda x: x["value"])
            ).alias("quantiles"),
        )
        out = out.join(F.broadcast(quantiles), "column_name", "left")
    else:
        out = out.withColumn("quantiles", F.lit(None).cast("array<double>"))
    stamp = F.current_timestamp() if profiled_at is None else literal_instant(profiled_at)
    return out.select(
        F.lit(table_name).alias("table_name"),
        "column_name",
        "dtype",
        "row_count",
        "null_count",
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        "min_val",
        "max_val",
        "mean_val",
        "stddev_val",
        "quantiles",
        stamp.alias("profiled_at"),
    )


def profile_shapes(df: DataFrame, columns: Sequence[str], bins: int = 20, k: int = 10) -> DataFrame:
    """Rows (column_name, histogram_json, top_k_json); histograms for numeric columns only."""
    parts = []
    for c in columns:
        top = top_k(df.select(_q(c).cast("string").alias("value")), "value", k).agg(
            F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "value", "count"))).alias("t")
        )
        text = F.to_json(F.transform("t", lambda x: F.struct(x["value"], x["count"])))
        part = top.select(F.lit(c).alias("column_name"), text.alias("top_k_json"))
        if is_numeric(df.schema[c].dataType):
            cells = histogram(df.select(_q(c).alias("v")), "v", bins).agg(
                F.sort_array(F.collect_list(F.struct("bin", "share"))).alias("h")
            )
            shape = cells.select(F.to_json(F.transform("h", lambda x: x["share"])).alias("j")).scalar()
        else:
            shape = F.lit(None).cast("string")
        parts.append(part.withColumn("histogram_json", shape))
    return union_all(parts)
