"""Two-sample Kolmogorov-Smirnov distance as a distributed prefix sum."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_double
from .order_stats import (
    cut_probabilities,
    default_buckets,
    edges_from,
    sampled,
    with_position,
    with_sample_flag,
)


def ks_drift(
    df: DataFrame,
    value: str | Column,
    reference: Column,
    targets: Mapping[str, Column],
    buckets: int | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Rows (name, score, p_value_approx, n_reference, n_target), one per target condition.

    The first aggregate brings back the sample sizes and the bucket edges. Then the rows
    collapse to value counts (partial aggregation first), every bucket of values computes
    the extremes of its own part of the two ECDFs, and the bucket summaries - at most
    ``buckets`` rows - are put together. An empty sample has a null score. ``weight`` is the
    number of equal rows a row stands for (stored value counts).
    """
    names = list(targets)
    k = range(len(names))
    times = F.lit(1) if weight is None else weight
    base = df.select(
        as_double(value).alias("v"),
        (F.coalesce(reference, F.lit(False)).cast("bigint") * times).alias("r"),
        *[
            (F.coalesce(c, F.lit(False)).cast("bigint") * times).alias(f"t{i}")
            for i, c in enumerate(targets.values())
        ],
    ).where(F.col("v").isNotNull())
    used = F.col("r") > 0
    for i in k:
        used = used | (F.col(f"t{i}") > 0)
    base = base.where(used)

    n_buckets = buckets or default_buckets(df.sparkSession)
    head = with_sample_flag(base).agg(
        F.percentile_approx(sampled(F.col("v")), F.lit(cut_probabilities(n_buckets)), 8 * n_buckets).alias("cuts"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("r"),
        *[F.coalesce(F.sum(f"t{i}"), F.lit(0)).alias(f"t{i}") for i in k],
    ).first()
    edges = edges_from(head["cuts"])
    n_r, n_t = head["r"], [head[f"t{i}"] for i in k]

    def gap(r: Column, t: Column, i: int) -> Column:
        return r / F.lit(float(n_r or 1)) - t / F.lit(float(n_t[i] or 1))

    counts = base.groupBy("v").agg(F.sum("r").alias("r"), *[F.sum(f"t{i}").alias(f"t{i}") for i in k])
    bucketed = with_position(counts, {"b": ("v", edges.cuts)})
    upto = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = bucketed.select(
        "b",
        "r",
        *[f"t{i}" for i in k],
        F.sum("r").over(upto).alias("cr"),
        *[F.sum(f"t{i}").over(upto).alias(f"c{i}") for i in k],
    )
    summary = cumulative.groupBy("b").agg(
        F.sum("r").alias("r"),
        *[F.sum(f"t{i}").alias(f"t{i}") for i in k],
        *[F.max(gap(F.col("cr"), F.col(f"c{i}"), i)).alias(f"hi{i}") for i in k],
        *[F.min(gap(F.col("cr"), F.col(f"c{i}"), i)).alias(f"lo{i}") for i in k],
    )
    # At most n_buckets rows from here on.
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    shifted = summary.select(
        *[
            F.greatest(
                F.abs(gap(past("r"), past(f"t{i}"), i) + F.col(f"hi{i}")),
                F.abs(gap(past("r"), past(f"t{i}"), i) + F.col(f"lo{i}")),
            ).alias(f"d{i}")
            for i in k
        ]
    )
    best = shifted.agg(*[F.max(f"d{i}").alias(f"d{i}") for i in k])
    rows = [
        F.struct(
            F.lit(names[i]).alias("name"),
            (F.col(f"d{i}") if n_r and n_t[i] else F.lit(None).cast("double")).alias("score"),
            F.lit(n_r).cast("bigint").alias("n_reference"),
            F.lit(n_t[i]).cast("bigint").alias("n_target"),
        )
        for i in k
    ]
    out = best.select(F.inline(F.array(*rows)))
    n1, n2 = F.col("n_reference").cast("double"), F.col("n_target").cast("double")
    effective = F.try_divide(n1 * n2, n1 + n2)
    p = F.lit(2.0) * F.least(F.exp(F.lit(-2.0) * F.sqrt(effective) * F.col("score")), F.lit(0.5))
    return out.select(
        "name", "score", F.when(F.col("score").isNotNull(), p).alias("p_value_approx"),
        "n_reference", "n_target",
    )
