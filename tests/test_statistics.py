import math
import random

import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from tablewatch.functions.arrays import array_mad, array_median, auto_threshold, modified_zscore_of
from tablewatch.operators import order_stats
from tablewatch.operators.chi_square import chi_square_drift, chi_square_upper_tail
from tablewatch.operators.correlation import pearson, spearman
from tablewatch.operators.histogram import divergences, histogram, js_drift, paired_histogram
from tablewatch.operators.ks import ks_drift
from tablewatch.operators.outliers import (
    interpolated_quantiles,
    iqr_outliers,
    median_and_mad,
    with_modified_zscore,
    with_zscore,
)


def two(spark, a, b, dtype="DOUBLE"):
    return spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], f"v {dtype}, ref BOOLEAN")


def pair(fn, spark, a, b, dtype="DOUBLE", **kw):
    (r,) = fn(two(spark, a, b, dtype), "v", F.col("ref"), {"t": ~F.col("ref")}, **kw).collect()
    return r


def ks_by_hand(a, b):
    return max(
        abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in set(a) | set(b)
    )


def test_ks_known_cases(spark):
    same = [1.0, 2.0, 3.0, 4.0, 5.0]
    assert pair(ks_drift, spark, same, same)["score"] == 0
    assert pair(ks_drift, spark, same, [100.0, 200.0, 300.0])["score"] == 1
    assert pair(ks_drift, spark, same, [])["score"] is None


@pytest.mark.parametrize("seed", range(3))
def test_ks_with_a_hot_value_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    draw = lambda: 5.0 if rng.random() < 0.4 else round(rng.gauss(5, 3), 2)
    a, b = [draw() for _ in range(700)], [draw() + 0.1 * (seed > 0) for _ in range(500)]
    r = pair(ks_drift, spark, a, b, buckets=8)
    assert r["score"] == pytest.approx(ks_by_hand(a, b), abs=1e-12)
    ne = len(a) * len(b) / (len(a) + len(b))
    assert r["p_value_approx"] == pytest.approx(2 * min(math.exp(-2 * math.sqrt(ne) * r["score"]), 0.5))


def test_ks_weights_stand_for_rows(spark):
    rows = two(spark, [1.0, 1.0, 2.0], [2.0, 3.0])
    counted = rows.groupBy("v", "ref").agg(F.count("*").alias("w"))
    (a,) = ks_drift(rows, "v", F.col("ref"), {"t": ~F.col("ref")}).collect()
    (b,) = ks_drift(counted, "v", F.col("ref"), {"t": ~F.col("ref")}, weight=F.col("w")).collect()
    assert a == b


def test_js_known_cases(spark):
    same = [1.0, 2.0, 3.0, 4.0, 5.0]
    assert pair(js_drift, spark, same, same, bins=5)["score"] == pytest.approx(0)
    far = pair(js_drift, spark, [1.0] * 100, [100.0] * 100, bins=10)
    assert far["score"] == pytest.approx(math.log(2))
    # Equal constants in samples of different size do not drift.
    assert pair(js_drift, spark, [1.0] * 3, [1.0] * 9)["score"] == pytest.approx(0)
    assert pair(js_drift, spark, [], [1.0])["score"] is None


def test_kl_guards_empty_cells(spark):
    cells = spark.createDataFrame([(0.5, 0.0), (0.5, 1.0)], "p DOUBLE, q DOUBLE")
    (r,) = divergences(cells, "p", "q").collect()
    assert r["kl"] == pytest.approx(0.5 * math.log(0.5 / 1e-10) + 0.5 * math.log(0.5))


def test_histogram_closes_the_last_bin(spark):
    rows = histogram(column(spark, [0.0, 1.0, 2.0, 10.0]), "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 1, 0, 0, 1] and sum(r["share"] for r in rows) == 1


def test_chi_square(spark):
    fruit = ["fig"] * 7 + ["plum"] * 2 + ["pear"]
    assert pair(chi_square_drift, spark, fruit, fruit[::-1], "STRING")["score"] == 0
    gone = pair(chi_square_drift, spark, ["fig"] * 7, ["plum"] * 7, "STRING", p_value=True)
    assert gone["score"] == 7 and gone["significant"] and gone["degrees_of_freedom"] == 1 and gone["p_value"] is None
    r = pair(chi_square_drift, spark, ["a"] * 6 + ["b"] * 6, ["a"] * 9 + ["b"] * 3, "STRING", p_value=True)
    assert r["score"] == pytest.approx(3.0) and r["p_value"] == pytest.approx(0.08326451666355)


@pytest.mark.parametrize("x,k,p", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05),
                                   (0.5, 10, 0.9999930), (100, 50, 3.4540e-05)])
def test_upper_tail(x, k, p):
    assert chi_square_upper_tail(x, k) == pytest.approx(p, rel=1e-3)


def test_iqr(spark):
    ten = [float(i) for i in range(1, 11)]
    assert iqr_outliers(column(spark, ten), "x").count() == 0
    (r,) = iqr_outliers(column(spark, [*ten[:9], 100.0]), "x").collect()
    assert r["x"] == 100.0 and r["q1"] == 3.25 and r["q3"] == 7.75
    assert iqr_outliers(column(spark, [None, None]), "x").count() == 0
    assert interpolated_quantiles(column(spark, [1.0, 2.0, 3.0, 4.0]), "x", [0.25]) == [1.75]


def test_zscores(spark):
    x = column(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    z = {r["x"]: r["zscore"] for r in with_zscore(x, "x").collect()}
    assert z[5.0] == pytest.approx(2 / math.sqrt(2.5)) and z[3.0] == 0
    assert [r["zscore"] for r in with_zscore(column(spark, [2.0]), "x").collect()] == [0.0]
    assert median_and_mad(column(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]), "x") == (3.5, 1.5)
    m = {r["x"]: r["modified_zscore"] for r in with_modified_zscore(column(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]), "x").collect()}
    assert m[100.0] == pytest.approx(0.6745 * 96.5 / 1.5)
    assert {r["modified_zscore"] for r in with_modified_zscore(column(spark, [1.0, 1.0]), "x").collect()} == {0.0}


def scalar(spark, values, expr):
    df = spark.createDataFrame([(values,)], "h ARRAY<DOUBLE>")
    return df.select(expr(F.col("h")).alias("r")).first()["r"]


def test_auto_threshold(spark):
    h = [7.0, 31.0, 4.0, 12.0, 9.0, 16.0, 5.0, 22.0]  # sorted: 4 5 7 9 12 16 22 31
    med, mad = 10.5, 5.5  # distances, sorted: 1.5 1.5 3.5 5.5 5.5 6.5 11.5 20.5
    assert scalar(spark, h, array_median) == pytest.approx(med)
    assert scalar(spark, h, array_mad) == pytest.approx(mad)
    assert scalar(spark, h, lambda c: auto_threshold(c, "mad", 3.0, 0.001, 100.0)) == pytest.approx(10.5 + 3 * 1.4826 * 5.5)
    assert scalar(spark, h, lambda c: auto_threshold(c, "sigma")) == pytest.approx(13.25 + 3 * math.sqrt(76.4375))
    assert scalar(spark, h, lambda c: auto_threshold(c, "iqr")) == pytest.approx(22 + 3 * (22 - 7))
    assert scalar(spark, h, lambda c: auto_threshold(c, "mad", max_threshold=2.0)) == 2.0
    assert scalar(spark, [], lambda c: auto_threshold(c, "mad", min_threshold=0.5)) == 0.5
    assert scalar(spark, None, auto_threshold) == 0.001
    assert scalar(spark, [1.0, 1.0], lambda c: modified_zscore_of(F.lit(5.0), c)) == 0.0


def test_correlations(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 6.0 - i, 1.0) for i in range(1, 6)], "x DOUBLE, y DOUBLE, r DOUBLE, k DOUBLE")
    assert pearson(df, "x", "y").first()["correlation"] == pytest.approx(1)
    assert pearson(df, "x", "r").first()["correlation"] == pytest.approx(-1)
    assert pearson(df, "x", "k").first()["correlation"] == 0
    assert spearman(df, "x", "r").first()["correlation"] == pytest.approx(-1)


def test_spearman_with_hot_values_matches_average_ranks(spark):
    import pandas as pd

    rng = random.Random(5)
    rows = [(0.0 if rng.random() < 0.4 else rng.gauss(0, 1), float(rng.randint(0, 9))) for _ in range(3000)]
    got = spearman(spark.createDataFrame(rows, "x DOUBLE, y DOUBLE"), "x", "y", buckets=16).first()
    frame = pd.DataFrame(rows, columns=["x", "y"])
    assert got["correlation"] == pytest.approx(frame["x"].rank().corr(frame["y"].rank()), abs=1e-9) and got["n"] == 3000


@pytest.mark.parametrize("limit", [5, 50, 10_000])
@pytest.mark.parametrize("shape", ["normal", "hot", "constant", "few", "infinite"])
def test_select_ranks_narrows_to_exact_values(spark, monkeypatch, shape, limit):
    monkeypatch.setattr(order_stats, "MAX_INTERVAL", limit)
    rng = random.Random(11)
    values = {
        "normal": lambda: rng.gauss(0, 1),
        "hot": lambda: 7.0 if rng.random() < 0.5 else rng.uniform(0, 100),
        "constant": lambda: 3.0,
        "few": lambda: float(rng.randint(0, 4)),
        "infinite": lambda: math.inf if rng.random() < 0.3 else rng.gauss(0, 1),
    }[shape]
    data = [values() for _ in range(3000)]
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    df = column(spark, [*data, None])
    got = order_stats.select_ranks(df, {"x": F.col("x")}, {"x": {str(q): (q, order_stats.nearest(q)) for q in qs}}).collect()
    ordered = sorted(data)
    assert {r["name"]: r["value"] for r in got} == {str(q): ordered[order_stats.nearest(q)(3000)] for q in qs}
    assert {r["n"] for r in got} == {3000}


def test_with_position(spark):
    cuts = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = column(spark, [0.0, 1.0, 1.5, 4.0, 20.0, 16.0])
    for inclusive in (True, False):
        got = order_stats.with_position(df, {"i": ("x", cuts)}, inclusive).collect()
        for r in got:
            assert r["i"] == sum((c <= r["x"]) if inclusive else (c < r["x"]) for c in cuts)


def test_drift_series_counts_the_reference_once(spark):
    """Cells of many targets equal a plain count; rows behind the explode do not grow with the targets."""
    pick = random.Random(12)
    odd = [0.1 * k for k in range(30)] + [1e300, -1e300, 5e-324, -0.0, 1e-9, -7.0]
    rows = [(pick.choice(odd) if k % 3 else pick.gauss(0, 4), pick.randint(-1, 40)) for k in range(3000)]
    df = spark.createDataFrame(rows, "x DOUBLE, day INT")
    for low_days in (0, 38):
        targets = {str(d): F.col("day") == d for d in range(low_days, 43)}
        cells = paired_histogram(df.where("abs(x) < 1e200 OR day > 20"), "x", F.col("day") < 3, targets, bins=7)
        want = {}
        for d in range(low_days, 43):
            held = [(x, day < 3, day == d) for x, day in rows if (day < 3 or day == d) and (abs(x) < 1e200 or day > 20)]
            low, high = min(h[0] for h in held), max(h[0] for h in held)
            for x, r, t in held:
                c = want.setdefault((str(d), max(0, min(math.floor((x - low) / ((high - low) / 7)), 6))), [0, 0])
                c[0] += r
                c[1] += t
        assert {(c["name"], c["bin"]): [c["n_reference"], c["n_target"]] for c in cells.collect()} == want
    assert paired_histogram(df.where("x is null"), "x", F.col("day") < 3, {"a": F.col("day") > 3}).count() == 0
