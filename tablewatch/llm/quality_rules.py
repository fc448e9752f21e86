"""Quality rules with robust multivariate outliers.

Fixed limits reject the plainly bad documents. The others are held against their kind: per language and
source, a minimum-covariance-determinant estimate of centre and spread of a transformed statistic vector is
found by concentration steps, and a document whose Mahalanobis distance is beyond the limit is rejected.

Every step covers all rows and is an aggregate: distances are counted in a histogram per group to find the
bound of the closest ``SHARE`` of the rows, then counts, sums and products of those rows are summed. A group
is never gathered anywhere, only its sums. Statistics are fixed-point integers, so sums do not depend on the
order of addition. The estimate of a group is drawn towards that of its language by the weight of ``PRIOR``
rows, so that small groups need no rule of their own, and variances have a floor, so a statistic that is
constant in a group rejects nothing by a hair.

Rows: null and empty texts have no words, so they fail the fixed limits. A null language or source is a
value of its own. A null doc_id is judged like any other row. Repeated rows each get a result. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewatch.llm.doc_stats import doc_counts
from tablewatch.llm.shared import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

POINT = 256  # fixed point of the statistics: sums of products stay in 64 bits up to 10^12 rows
SHARE = 0.75  # of the rows of a group determine its estimate
INFLATE = 1.33  # makes the spread of the closest three quarters of a normal group in 7 dimensions consistent
STEPS = 4
PRIOR = 50
LIMIT = 29.9  # 0.9999 quantile of chi-square with 7 degrees of freedom
BINS_PER_E = 64  # histogram of distances: bins on a logarithmic scale
MAX_BROADCAST_GROUPS = 10_000

# name, transformed statistic, least standard deviation
STATISTICS: tuple[tuple[str, str, float], ...] = (
    ("length", "ln(1 + n_words)", 0.2),
    ("word_length", "word_chars / n_words", 0.25),
    ("symbols", "ln(1 + 100 * n_symbols / n_words)", 0.25),
    ("dup_lines", "ln(1 + 20 * n_dup_lines / n_lines)", 0.7),
    ("repeats", "ln(1 + 20 * n_repeat_words / n_words)", 0.6),
    ("capitals", "ln(1 + 20 * n_upper / n_chars)", 0.25),
    ("digits", "ln(1 + 20 * n_digits / n_chars)", 0.5),
)
P = len(STATISTICS)
NAMES = [s[0] for s in STATISTICS]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
FLOOR = np.array([s[2] for s in STATISTICS])
ESTIMATE = "`group` string, centre array<double>, whiten array<double>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre and whitening matrix of each group from its sums and those of its language."""
    for batch in batches:
        num = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in batch.schema.names if k != "group"}

        def moments(prefix: str, n: np.ndarray, num=num) -> tuple[np.ndarray, np.ndarray]:
            mean = np.stack([num[f"{prefix}s{i}"] for i in range(P)], 1) / n[:, None] / POINT
            square = np.zeros((len(n), P, P))
            for i, j in PAIRS:
                square[:, i, j] = square[:, j, i] = num[f"{prefix}s{i}_{j}"] / n / POINT**2
            return mean, square

        mine, own = moments("", num["n"])
        wide, all_own = moments("lang_", num["lang_n"])
        weight = (num["n"] / (num["n"] + PRIOR))[:, None]
        centre = weight * mine + (1 - weight) * wide
        second = weight[:, :, None] * own + (1 - weight)[:, :, None] * all_own
        spread = INFLATE * (second - centre[:, :, None] * centre[:, None, :]) + np.diag(FLOOR**2)
        whiten = np.linalg.inv(np.linalg.cholesky(spread))
        yield pa.record_batch(
            [batch.column("group"), pa.array(list(centre)), pa.array(list(whiten.reshape(-1, P * P)))],
            names=["group", "centre", "whiten"],
        )


def _with(rows: DataFrame, per_group: DataFrame, few: bool) -> DataFrame:
    """Rows of a hot group are met by a broadcast of the groups, if those are few, or a skew-splittable join."""
    return rows.join(F.broadcast(per_group) if few else per_group, "group")


def _distance() -> Column:
    terms = []
    for i in range(P):
        line = [F.col("whiten")[i * P + j] * (F.col(NAMES[j]) / POINT - F.col("centre")[j]) for j in range(i + 1)]
        own = line[0]
        for x in line[1:]:
            own = own + x
        terms.append(own * own)
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return total


def _bin() -> Column:
    return F.floor(F.lit(BINS_PER_E) * F.log1p("distance")).cast("int")


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile ranges, coordinate by coordinate."""
    quartiles = rows.groupBy("group").agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in NAMES))
    sd = [F.greatest((F.col(c)[2] - F.col(c)[0]) / (1.349 * POINT), F.lit(float(FLOOR[i]))) for i, c in enumerate(NAMES)]
    return quartiles.select(
        "group", F.array(*(F.col(c)[1] / F.lit(float(POINT)) for c in NAMES)).alias("centre"),
        F.array(*(1 / sd[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P))).alias("whiten"),
    )


def _concentrate(rows: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """One step: the estimate of the ``SHARE`` of rows closest to the last estimate."""
    measured = _with(rows, estimate, few).withColumn("distance", _distance()).withColumn("bin", _bin())
    counted = measured.groupBy("group", "bin").agg(F.count(F.lit(1)).alias("n"))
    # a window over at most some thousand bins of a group
    upto = F.sum("n").over(Window.partitionBy("group").orderBy("bin"))
    bounds = counted.select("group", "bin", upto.alias("upto"), F.sum("n").over(Window.partitionBy("group")).alias("all")).where(
        F.col("upto") >= SHARE * F.col("all")
    ).groupBy("group").agg(F.min("bin").alias("bound"))
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(NAMES[i]).alias(f"s{i}") for i in range(P)),
            *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}_{j}") for i, j in PAIRS)]
    own = written(_with(measured, bounds, few).where("bin <= bound").groupBy("group", "language").agg(*sums))
    names = [c for c in own.columns if c not in ("group", "language")]
    wide = own.groupBy("language").agg(*(F.sum(c).alias(f"lang_{c}") for c in names))
    ready = own.join(wide, own["language"].eqNullSafe(wide["language"])).select("group", *names, *(f"lang_{c}" for c in names))
    return written(ready.mapInArrow(_solve, ESTIMATE))


def judge(docs: DataFrame, steps: int = STEPS, limit: float = LIMIT) -> DataFrame:
    """doc_id, statistics, base_failed, distance (null where the fixed limits decide) and kept of every row."""
    counts = written(doc_counts(docs, "lang", "source"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    marked = counts.withColumn("base_failed", failed)
    missing = F.lit("\u0002")
    rows = written(
        marked.where(~F.col("base_failed")).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            F.col("lang").alias("language"),
            F.concat_ws("\u0001", F.coalesce("lang", missing), F.coalesce("source", missing)).alias("group"),
            *(F.round(F.expr(sql) * POINT).cast("long").alias(name) for name, sql, _ in STATISTICS),
        )
    )
    estimate = written(_start(rows))
    few = estimate.count() <= MAX_BROADCAST_GROUPS
    for _ in range(steps):
        estimate = _concentrate(rows, estimate, few)
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    passed = _with(rows, estimate, few).withColumn("distance", _distance())
    return passed.select(*out, F.lit(False).alias("base_failed"), (F.col("distance") <= limit).alias("kept"), "distance").unionAll(
        marked.where("base_failed").select(*out, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    )
