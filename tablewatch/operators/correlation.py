"""Pearson and Spearman correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_double
from .order_stats import Edges, bucket_edges, running_totals

# Fixed value: lower limit of the denominator, so a constant column gives 0.
DENOMINATOR_FLOOR = 1e-10


def _moments(x: Column, y: Column) -> Column:
    """Correlation as one algebraic aggregate (partial on every task)."""
    n = F.count(F.lit(1)).cast("double")
    cov, vx, vy = F.covar_pop(x, y) * n, F.var_pop(x) * n, F.var_pop(y) * n
    return cov / F.greatest(F.sqrt(vx * vy), F.lit(DENOMINATOR_FLOOR))


def _pairs(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, as_double(x).alias("x"), as_double(y).alias("y")).where(
        "x IS NOT NULL AND y IS NOT NULL"
    )


def pair_metrics(x: str, y: str) -> dict[str, Column]:
    """Correlation and number of pairs as aggregates of a whole table: rows without a pair add nothing."""
    a, b = as_double(F.col(f"`{x}`")), as_double(F.col(f"`{y}`"))
    paired = a.isNotNull() & b.isNotNull()
    a, b = F.when(paired, a), F.when(paired, b)
    n = F.count_if(paired).cast("double")
    spread = F.sqrt(F.var_pop(a) * n * F.var_pop(b) * n)
    return {"correlation": F.covar_pop(a, b) * n / F.greatest(spread, F.lit(DENOMINATOR_FLOOR)), "n": F.count_if(paired)}


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., correlation, n) over rows where both values are present."""
    return (
        _pairs(df, x, y, by)
        .groupBy(*by)
        .agg(_moments(F.col("x"), F.col("y")).alias("correlation"), F.count(F.lit(1)).alias("n"))
    )


def average_ranks(counts: DataFrame, value: str, n: str, edges: Edges) -> DataFrame:
    """Rows (value, rank): mean 1-based rank of each distinct value."""
    totals = running_totals(counts, value, [n], edges)
    return totals.select(value, (F.col(f"cum_{n}") - (F.col(n) - 1) / F.lit(2.0)).alias("rank"))


def _join_rank(pairs: DataFrame, ranks: DataFrame, value: str, other: str, hot: Sequence[float]) -> DataFrame:
    """Attach the rank of ``value``; a value known to be hot is split into as many parts as the shuffle has.

    Hot values are the repeated bucket edges, each holding more than one bucket of rows,
    so there are fewer of them than buckets. The part comes from the other column, which
    keeps it stable when a task is retried.
    """
    split = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(value).isin(list(hot)) if hot else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64(other), F.lit(split))).otherwise(F.lit(0))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(split - 1))).otherwise(F.array(F.lit(0)))
    spread = ranks.select(value, F.col("rank").alias(f"rank_{value}"), F.explode(parts).alias("_part"))
    return (
        pairs.withColumn("_part", part.cast("int"))
        .join(spread, [value, "_part"])
        .drop("_part")
    )


def spearman(df: DataFrame, x: str, y: str, buckets: int | None = None) -> DataFrame:
    """One row (correlation, n): Pearson of tie-averaged ranks.

    Equal pairs are counted first. Ranks come from a distributed prefix sum over value
    counts and are centred before they are multiplied.
    """
    pairs = (
        _pairs(df, x, y).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    )
    joined = pairs
    for value, other in (("x", "y"), ("y", "x")):
        column = _pairs(df, x, y).select(value)
        edges = bucket_edges(column, value, buckets)
        counts = column.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
        joined = _join_rank(joined, average_ranks(counts, value, "n", edges), value, other, edges.hot)
    total = _pairs(df, x, y).agg(F.count(F.lit(1)).alias("n")).scalar()
    centre = (total + 1) / F.lit(2.0)
    w, rx, ry = F.col("w"), F.col("rank_x") - centre, F.col("rank_y") - centre
    # Ranks are centred exactly, so the products need no second pass.
    cov, vx, vy = F.sum(w * rx * ry), F.sum(w * rx * rx), F.sum(w * ry * ry)
    return joined.agg(
        (cov / F.greatest(F.sqrt(vx * vy), F.lit(DENOMINATOR_FLOOR))).alias("correlation"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"),
    )
