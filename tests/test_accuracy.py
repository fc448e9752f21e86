"""The 29 injected anomalies of the reference benchmark, with fixed draws."""

import random

import pytest
from pyspark.sql import functions as F
from test_monitors import AS_OF, at, one, runs

from tablewatch.plans import expectations as E
from tablewatch.plans import monitors as M
from tablewatch.plans.monitors.table_metrics import score_volume
from tablewatch.plans.suite import run_suite


@pytest.mark.parametrize("share", [0.0, 0.01, 0.05, 0.10, 0.25, 0.50])
def test_not_null(spark, share):
    df = spark.range(1000).select(F.when(F.col("id") >= int(1000 * share), F.lit(50.0)).alias("value"))
    r = one(run_suite(E.ExpectationSuite("s", [E.not_null("value", 0.02)]), df))
    assert r["success"] == (share <= 0.02)


# A halving and a doubling stay within the limits learned from runs of 8,000 to 12,000.
@pytest.mark.parametrize("count,alert", [(9500, False), (5000, False), (1000, True), (0, True), (20000, False), (50000, True)])
def test_volume(spark, count, alert):
    rng = random.Random(42)
    past = [rng.randint(8000, 12000) for _ in range(15)]
    r = score_volume(runs(spark, *past, count), M.Volume("v", "t")).orderBy(F.desc("ts")).first()
    assert r["alert"] == alert


@pytest.mark.parametrize("minutes", [30, 60, 120, 180, 360, 720, 1440])
def test_freshness(spark, minutes):
    last = at(spark, AS_OF).select((F.col("ts") - F.expr(f"INTERVAL {minutes} MINUTES")).alias("ts"))
    r = one(M.check_freshness(last, M.Freshness("f", "t", max_age_seconds=7200), AS_OF))
    assert r["alert"] == (minutes > 120)


@pytest.mark.parametrize("shift,alert", [(0, False), (1, False), (3, False), (5, False), (10, True), (20, True)])
def test_distribution(spark, shift, alert):
    rng = random.Random(42)
    rows = [(rng.gauss(50, 10), True) for _ in range(1000)] + [(rng.gauss(50 + shift, 10), False) for _ in range(1000)]
    df = spark.createDataFrame(rows, "x DOUBLE, ref BOOLEAN")
    r = one(M.check_distribution(df, M.Distribution("d", "t", column="x", reference="ref", target="NOT ref"), AS_OF))
    assert r["alert"] == alert


@pytest.mark.parametrize("schema,alert", [("a INT, b INT, c INT", False), ("a INT, b INT, c INT, d INT", True), ("a INT, c INT", True), ("z INT, b INT, c INT", True)])
def test_schema(spark, schema, alert):
    snap = lambda s: M.schema_snapshot(spark.createDataFrame([], s), "t")
    r = one(M.check_schema(M.Schema("s", "t"), snap(schema), snap("a INT, b INT, c INT"), AS_OF))
    assert r["alert"] == alert
