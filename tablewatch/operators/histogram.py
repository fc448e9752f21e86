"""Equal-width histograms and the divergences computed from them."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import as_double, ratio
from .local_rows import constant_rows
from .order_stats import with_position

# Fixed value: guard added to an empty cell of q in KL(p || q).
EMPTY_CELL_GUARD = 1e-10


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin index; the last bin is closed, and a zero-width range puts everything into bin 0."""
    width = (high - low) / F.lit(float(bins))
    # held to the range as a double, as a value far outside given limits has no integer bin
    held = F.greatest(F.lit(0.0), F.least(F.try_divide(value - low, width), F.lit(float(bins - 1))))
    return F.when(width <= 0, F.lit(0)).otherwise(F.floor(held).cast("int"))


def histogram(
    df: DataFrame, value: str, bins: int = 20, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Rows (bin, bin_low, bin_high, count, share) for every bin, empty ones included."""
    v = df.select(as_double(value).alias("v")).where("v IS NOT NULL")
    limits = v.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("r")).scalar()
    lo = F.lit(float(low)) if low is not None else limits["lo"]
    hi = F.lit(float(high)) if high is not None else limits["hi"]
    counts = v.groupBy(bin_of(F.col("v"), lo, hi, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    # The grid has ``bins`` rows, and so do the counts.
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(F.broadcast(counts), "bin", "left")
    width = (hi - lo) / F.lit(float(bins))
    everything = Window.partitionBy()
    return full.select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_low"),
        (lo + (F.col("bin") + 1) * width).alias("bin_high"),
        F.coalesce("count", F.lit(0)).alias("count"),
        ratio(F.coalesce("count", F.lit(0)), F.sum("count").over(everything), 0.0).alias("share"),
    )


def kl_term(p: Column, q: Column) -> Column:
    guarded = F.when(q > 0, q).otherwise(q + F.lit(EMPTY_CELL_GUARD))
    return F.when(p > 0, p * F.ln(p / guarded)).otherwise(F.lit(0.0))


def divergences(cells: DataFrame, p: str, q: str, by: list[str] | None = None) -> DataFrame:
    """KL(p || q) and Jensen-Shannon divergence of two share columns over matching cells."""
    pc, qc = F.col(p), F.col(q)
    mid = (pc + qc) / F.lit(2.0)
    return cells.groupBy(*(by or [])).agg(
        F.sum(kl_term(pc, qc)).alias("kl"),
        (F.sum(kl_term(pc, mid) + kl_term(qc, mid)) / F.lit(2.0)).alias("js"),
    )


def _first_of_bins(low: float, high: float, bins: int) -> list[float]:
    """For bins 1 to ``bins`` - 1, the smallest double from ``low`` on that ``bin_of`` puts there or higher.

    Found by halving the ordered doubles between the limits, so counts between these values are those of ``bin_of``
    to the last row, whatever its rounding. A bin that no value reaches starts above ``high``.
    """
    width = (high - low) / bins
    wanted = np.arange(1, bins)
    if not width > 0:
        return [math.inf] * (bins - 1)

    def ordered(x: float) -> int:
        (i,) = np.array([x + 0.0]).view(np.int64).tolist()
        return i if i >= 0 else -(i & (2**63 - 1))

    def double(i: np.ndarray) -> np.ndarray:
        return np.where(i >= 0, np.abs(i).view(np.float64), -np.abs(i).view(np.float64))

    below = np.full(bins - 1, ordered(low) - 1, dtype=np.int64)
    above = np.full(bins - 1, ordered(high) + 1, dtype=np.int64)
    with np.errstate(all="ignore"):
        while (above > below + 1).any():
            # halves apart, as the sum or difference of two orders may not fit
            middle = (below >> 1) + (above >> 1) + (below & above & 1)
            q = (double(middle) - low) / width
            reached = np.where(np.isnan(q), bins - 1, np.clip(np.floor(q), 0, bins - 1)) >= wanted
            open_ = above > below + 1
            above, below = np.where(reached & open_, middle, above), np.where(~reached & open_, middle, below)
    return [float(x) if i <= ordered(high) else math.inf for x, i in zip(double(above), above.tolist(), strict=True)]


def paired_histogram(
    df: DataFrame,
    value: str | Column,
    reference: Column,
    targets: Mapping[str, Column],
    bins: int = 20,
    weight: Column | None = None,
) -> DataFrame:
    """Rows (name, bin, n_reference, n_target, p, q): reference p and target q on shared limits.

    Every pair uses the minimum and maximum over both of its samples. ``reference`` and
    ``targets`` are row conditions on ``df``; one scan for the limits, one for the counts.
    The reference is summarised once for all targets: its rows are counted between the merged bin bounds of
    all pairs, and a pair's bins are differences of running totals over those at most ``bins`` x targets counts. So a row
    is expanded once for the reference and once per target it belongs to, however many targets there are.
    """
    names = list(targets)
    base = df.select(
        as_double(value).alias("v"),
        F.coalesce(reference, F.lit(False)).alias("r"),
        *[F.coalesce(c, F.lit(False)).alias(f"t{i}") for i, c in enumerate(targets.values())],
        (F.lit(1) if weight is None else weight).cast("bigint").alias("w"),
    ).where(F.col("v").isNotNull())
    both = [F.col("r") | F.col(f"t{i}") for i in range(len(names))]
    limits = base.agg(
        *[F.min(F.when(b, F.col("v"))).alias(f"lo{i}") for i, b in enumerate(both)],
        *[F.max(F.when(b, F.col("v"))).alias(f"hi{i}") for i, b in enumerate(both)],
    ).first()
    known = [i for i in range(len(names)) if limits[f"lo{i}"] is not None]
    starts = {i: _first_of_bins(limits[f"lo{i}"], limits[f"hi{i}"], bins) for i in known}
    cuts = sorted({c for s in starts.values() for c in s if c < math.inf})
    at = {c: k + 1 for k, c in enumerate(cuts)}  # with_position of a value that equals the cut
    own = [
        F.when(F.col(f"t{i}"), F.struct(
            F.lit(i).alias("i"), bin_of(F.col("v"), F.lit(limits[f"lo{i}"]), F.lit(limits[f"hi{i}"]), bins).alias("at")
        )) for i in known
    ]
    # The reference is number -1, and told by its place among the cuts instead of a bin.
    placed = with_position(base, {"_cut": ("v", cuts)})
    told = F.when(F.col("r"), F.struct(F.lit(-1).alias("i"), F.col("_cut").cast("int").alias("at")))
    counted = (
        placed.select("w", F.explode(F.filter(F.array(told, *own), lambda e: e.isNotNull())).alias("e"))
        .groupBy("e.i", "e.at")
        .agg(F.sum("w").alias("n"))
    )
    # The last place of every bin of every pair. From here on, rows are bounded by the request: pairs times bins.
    ends = [place - 1 for i in known for place in [*(at.get(c, len(cuts) + 1) for c in starts[i]), len(cuts) + 1]]
    bounds = df.sparkSession.range(len(ends)).select(
        F.get(F.lit(known or [0]), (F.col("id") / bins).cast("int")).alias("i"),
        F.pmod("id", F.lit(bins)).cast("int").alias("bin"),
        F.get(F.lit(ends or [0]), F.col("id").cast("int")).alias("at"),
        F.lit(0).cast("bigint").alias("n"),
    )
    upto = F.sum("n").over(Window.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    running = bounds.unionByName(counted.where("i = -1").withColumn("bin", F.lit(0))).withColumn("upto", upto).where("i >= 0")
    before = F.lag("upto", 1, 0).over(Window.partitionBy("i").orderBy("bin"))
    summary = running.select(
        "i", F.get(F.lit(names), F.col("i")).alias("name"), "bin", (F.col("upto") - before).alias("n_reference")
    )
    cells = summary.join(
        counted.where("i >= 0").select("i", F.col("at").alias("bin"), F.col("n").alias("n_target")), ["i", "bin"], "left"
    ).select("name", "bin", "n_reference", F.coalesce("n_target", F.lit(0)).alias("n_target")).where("n_reference > 0 OR n_target > 0")
    pair = Window.partitionBy("name")
    return cells.select(
        "name",
        "bin",
        "n_reference",
        "n_target",
        ratio(F.col("n_reference"), F.sum("n_reference").over(pair)).alias("p"),
        ratio(F.col("n_target"), F.sum("n_target").over(pair)).alias("q"),
    )


def js_drift(
    df: DataFrame,
    value: str | Column,
    reference: Column,
    targets: Mapping[str, Column],
    bins: int = 20,
    weight: Column | None = None,
) -> DataFrame:
    """Rows (name, score, n_reference, n_target); the score is null when a sample is empty."""
    cells = paired_histogram(df, value, reference, targets, bins, weight)
    p, q = F.col("p"), F.col("q")
    mid = (p + q) / F.lit(2.0)
    scored = cells.groupBy("name").agg(
        F.sum("n_reference").alias("n_reference"),
        F.sum("n_target").alias("n_target"),
        (F.sum(kl_term(p, mid) + kl_term(q, mid)) / F.lit(2.0)).alias("raw"),
    )
    names = constant_rows(df.sparkSession, "name STRING", [(n,) for n in targets])
    n_r, n_t = F.coalesce("n_reference", F.lit(0)), F.coalesce("n_target", F.lit(0))
    return names.join(scored, "name", "left").select(
        "name",
        F.when((n_r > 0) & (n_t > 0), F.col("raw")).alias("score"),
        n_r.alias("n_reference"),
        n_t.alias("n_target"),
    )


def kl_to_normal(df: DataFrame, value: str) -> DataFrame:
    """One row (kl, bins, n): divergence of a column from the normal fitted to it.

    round(sqrt(n)) bins, kept within 10..100, cover mean +- 2 population sigma (sigma at
    least 1e-10). Bins are half open, values outside are left out, both sides are
    renormalised and empty cells contribute nothing.
    """
    v = df.select(as_double(value).alias("v")).where("v IS NOT NULL")
    fitted = v.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.avg("v").alias("mean"),
            F.greatest(F.stddev_pop("v"), F.lit(1e-10)).alias("sigma"),
            F.greatest(F.lit(10), F.least(F.lit(100), F.round(F.sqrt(F.count(F.lit(1))), 0)))
            .cast("int")
            .alias("bins"),
        ).alias("fit")
    ).scalar()
    mean, sigma, bins = fitted["mean"], fitted["sigma"], fitted["bins"]
    width = F.lit(4.0) * sigma / bins
    index = F.floor((F.col("v") - (mean - F.lit(2.0) * sigma)) / width).cast("int")
    cells = (
        v.select(index.alias("bin"), bins.alias("bins"), mean.alias("mean"), sigma.alias("sigma"),
                 fitted["n"].alias("n"))
        .where((F.col("bin") >= 0) & (F.col("bin") < F.col("bins")))
        .groupBy("bin", "bins", "mean", "sigma", "n")
        .agg(F.count(F.lit(1)).alias("o"))
    )

    def density(i: Column) -> Column:
        # z of a bin centre depends on the bin count only: -2 + (i + 0.5) * 4 / bins.
        z = F.lit(-2.0) + (i + F.lit(0.5)) * F.lit(4.0) / F.col("bins")
        return F.exp(F.lit(-0.5) * z * z) / F.lit(math.sqrt(2 * math.pi)) * F.lit(4.0) / F.col("bins")

    mass = F.aggregate(
        F.sequence(F.lit(0), F.col("bins") - 1), F.lit(0.0), lambda acc, i: acc + density(i)
    )
    expected = density(F.col("bin")) / F.greatest(mass, F.lit(1e-10))
    # sum(p * ln(p / e)) with p = o / sum(o), written with sums only.
    summed = cells.agg(
        F.sum(F.when(expected > 0, F.col("o") * F.ln(F.col("o") / expected))).alias("w"),
        F.sum(F.when(expected > 0, F.col("o"))).alias("used"),
        F.sum("o").alias("s"),
        F.max("bins").alias("b"),
        F.max("n").alias("n_rows"),
    )
    inside = F.try_divide(F.col("w") - F.col("used") * F.ln(F.col("s").cast("double")), F.col("s"))
    # No value inside the range: all cells empty, divergence 0. No value at all: null.
    n_rows = F.coalesce(F.col("n_rows"), fitted["n"], F.lit(0))
    return summed.select(
        F.when(n_rows > 0, F.coalesce(inside, F.lit(0.0))).alias("kl"),
        F.coalesce(F.col("b"), bins).alias("bins"),
        n_rows.cast("bigint").alias("n"),
    )
