"""Chi-square comparison of label counts."""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio

# Ship the tail function with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: 5% critical value at one degree of freedom, the default for every test.
CRITICAL_5_PERCENT = 3.841


def chi_square_drift(
    df: DataFrame,
    label: str | Column,
    reference: Column,
    targets: Mapping[str, Column],
    critical: float = CRITICAL_5_PERCENT,
    p_value: bool = False,
    weight: Column | None = None,
) -> DataFrame:
    """Rows (name, score, degrees_of_freedom, critical_value, significant, n_reference, n_target).

    Reference counts are scaled to the target's total; labels the reference has not seen
    add to the degrees of freedom but not to the statistic. The score is null for an empty
    target. ``p_value=True`` adds the upper tail (null when a label is new).
    """
    names = list(targets)
    k = range(len(names))
    times = F.lit(1) if weight is None else weight
    c = F.col(label) if isinstance(label, str) else label
    base = df.select(
        c.cast("string").alias("label"),
        (F.coalesce(reference, F.lit(False)).cast("bigint") * times).alias("r"),
        *[
            (F.coalesce(t, F.lit(False)).cast("bigint") * times).alias(f"t{i}")
            for i, t in enumerate(targets.values())
        ],
    ).where(F.col("label").isNotNull())
    counts = base.groupBy("label").agg(
        F.sum("r").alias("r"), *[F.sum(f"t{i}").alias(f"t{i}") for i in k]
    )
    totals = counts.agg(
        F.struct(F.sum("r").alias("r"), *[F.sum(f"t{i}").alias(f"t{i}") for i in k]).alias("totals")
    ).scalar()

    def expected(i: int) -> Column:
        return ratio(F.col("r"), totals["r"], 0.0) * totals[f"t{i}"]

    terms = []
    for i in k:
        e, o = expected(i), F.col(f"t{i}")
        terms += [
            F.sum(F.when(e > 0, (o - e) * (o - e) / e)).alias(f"s{i}"),
            F.count_if((F.col("r") > 0) | (o > 0)).alias(f"c{i}"),
            F.count_if((F.col("r") == 0) & (o > 0)).alias(f"u{i}"),
            F.sum(o).alias(f"n{i}"),
        ]
    wide = counts.agg(F.sum("r").alias("r"), *terms)
    rows = [
        F.struct(
            F.lit(names[i]).alias("name"),
            F.when(F.col(f"n{i}") > 0, F.coalesce(F.col(f"s{i}"), F.lit(0.0))).alias("score"),
            (F.greatest(F.col(f"c{i}"), F.lit(1)) - 1).cast("bigint").alias("degrees_of_freedom"),
            F.col(f"u{i}").alias("unseen_labels"),
            F.coalesce(F.col("r"), F.lit(0)).alias("n_reference"),
            F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n_target"),
        )
        for i in k
    ]
    out = wide.select(F.inline(F.array(*rows))).select(
        "name",
        "score",
        "degrees_of_freedom",
        F.lit(float(critical)).alias("critical_value"),
        F.coalesce(F.col("score") > F.lit(float(critical)), F.lit(False)).alias("significant"),
        "unseen_labels",
        "n_reference",
        "n_target",
    )
    if p_value:
        tail = F.pandas_udf(_upper_tails, "double")
        out = out.withColumn(
            "p_value", F.when(F.col("unseen_labels") == 0, tail("score", "degrees_of_freedom"))
        )
    return out


def chi_square_upper_tail(x: float, dof: int) -> float:
    """P(X > x) for a chi-square variable: the regularised upper incomplete gamma function."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    log_front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:
        term = total = 1.0 / a
        j = a
        while term > total * 1e-16:
            j += 1
            term *= z / j
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    # Continued fraction, evaluated with the modified Lentz method.
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return h * math.exp(log_front)
    raise ArithmeticError(f"the tail of chi-square {x} with {dof} degrees of freedom does not converge")


def _upper_tails(score: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) else chi_square_upper_tail(float(x), int(d)) for x, d in zip(score, dof)],
        dtype="float64",
    )
