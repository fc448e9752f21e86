"""Failures while running, and scans that monitors share."""

import pytest
from pyspark.sql import functions as F

from tablewatch.operators.correlation import pearson
from tablewatch.plans import expectations as E
from tablewatch.plans import monitors as M
from tablewatch.plans.isolate import settled
from tablewatch.plans.monitors import run, shared_scan
from tablewatch.plans.suite import run_suite

AS_OF = "2024-01-10 00:00:00"


@pytest.fixture
def usage(spark, tmp_path):
    rows = [(k, float(k % 7), float(k * 2 % 11), "ab"[k % 2] if k % 5 else None, k % 3, f"2024-01-0{k % 9 + 1} 00:00:00") for k in range(200)]
    spark.createDataFrame(rows, "k INT, x DOUBLE, cost DOUBLE, team STRING, z INT, ts STRING").write.parquet(str(tmp_path / "usage"))
    return spark.read.parquet(str(tmp_path / "usage"))


def configs():
    return [
        M.Freshness("fresh", "usage"), M.Freshness("fresh-by", "usage", by=["team"]),
        M.Correlation("pair", "usage", column_x="x", column_y="cost"),
        M.ReferentialIntegrity("keys", "usage", columns=["k"], target_table="known", target_columns=["id"]),
        M.Cost("spent", "usage", budget=100.0), M.Cost("spent-by", "usage", resource_column="team", budget=100.0),
    ]


def test_one_scan_for_all_aggregates(spark, usage):
    tables = {"usage": usage, "known": spark.range(50)}
    asks = [shared_scan.ask_of(c, tables, AS_OF, None) for c in configs()]
    frames = run.shared_frames(asks, tables)
    plan = frames["usage"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
    assert "ReadSchema: struct<k:int,x:double,cost:double,team:string,ts:string>" in plan


def test_shared_results_equal_those_of_each_monitor_alone(spark, usage):
    for rows in (usage, usage.where("false")):
        tables = {"usage": rows, "known": spark.range(50)}
        together = run.run_monitors(configs(), tables, AS_OF).drop("details")
        alone = [run._check(c, tables, AS_OF, None, None).drop("details") for c in configs()]
        tidy = lambda df: sorted(str(r) for r in df.withColumn("score", F.round("score", 9)).collect())
        assert tidy(together) == sorted(x for df in alone for x in tidy(df))


def test_pair_metrics_equal_pearson(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (4.0, 1.0), (None, 5.0), (3.0, None), (nan, 1.0), (9.0, 9.5)], "x DOUBLE, y DOUBLE")
    from tablewatch.operators.correlation import pair_metrics

    got = df.agg(*(e.alias(k) for k, e in pair_metrics("x", "y").items())).first()
    want = pearson(df, "x", "y").first()
    assert got["n"] == want["n"] == 4 and got["correlation"] == pytest.approx(want["correlation"])


def test_failing_monitors_leave_the_others(spark, usage):
    @F.udf("double")
    def broken(_):
        raise RuntimeError("no answer")

    tables = {"usage": usage.withColumn("slow", broken("x")), "known": spark.range(50)}
    cfgs = [
        *configs(), M.Cost("broken", "usage", cost_column="slow", budget=1.0),
        M.CustomSql("zero", "usage", query="SELECT sum(k / z) FROM usage"),
        M.CustomSql("fine", "usage", query="SELECT sum(k) FROM usage", expected=0.0, comparison="<"),
    ]
    got = {r["monitor_id"]: r for r in run.run_monitors(cfgs, tables, AS_OF).collect()}
    errors = {i: r["message"] for i, r in got.items() if r["monitor_type"] == "error"}
    assert errors["zero"] == "Monitor failed: DIVIDE_BY_ZERO" and set(errors) == {"zero", "broken"}
    assert got["fine"]["score"] == 19900.0 and got["spent"]["score"] == sum(k * 2 % 11 for k in range(200))
    assert {"fresh", "fresh-by:a", "fresh-by:null", "spent-by:b", "pair", "keys"} <= set(got)


def test_suite_with_failing_expressions(spark, usage):
    suite = E.ExpectationSuite("s").add(
        E.not_null("team"), E.custom("zero", "k / z > 0"), E.custom("fine", "k >= 0"), E.custom("cast", "CAST(team AS INT) = 1"), E.unique("k")
    )
    got = {r["position"]: r for r in run_suite(suite, usage).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert [got[k]["success"] for k in range(5)] == [False, False, True, False, True]
    assert "DIVIDE_BY_ZERO" in got[1]["exception"] and "CAST_INVALID_INPUT" in got[3]["exception"]
    assert all(got[k]["exception"] is None for k in (0, 2, 4))


def test_halving_finds_each_failure(spark):
    def build(items):
        return spark.range(1).select(*(F.expr(f"1 div {i}").alias(f"c{k}") for k, i in enumerate(items)))

    done, refused = settled([1, 2, 0, 4, 5, 0, 7], build)
    assert [i for i, _ in refused] == [0, 0] and sorted(i for _, items in done for i in items) == [1, 2, 4, 5, 7]
    assert settled([], build) == ([], [])
