import json
import math

import pytest
from conftest import column

from tablewatch.plans import expectations as E
from tablewatch.plans.suite import failing_rows, run_suite, summarize


def check(df, *items):
    rows = run_suite(E.ExpectationSuite("s", list(items)), df).collect()
    return [r for r in sorted(rows, key=lambda r: r["position"])]


def verdicts(df, *items):
    return [r["success"] for r in check(df, *items)]


def test_passing_cases(people):
    assert all(
        verdicts(
            people,
            E.not_null("name"), E.unique("name"), E.between("age", 20, 50), E.row_count_between(1, 10),
            E.mean_between("age", 30, 40), E.stddev_between("age", 5, 10), E.min_between("age", 20, 30),
            E.max_between("age", 40, 50), E.match_regex("name", "^[a-e]$"), E.not_match_regex("name", "z"),
            E.distinct_equal_set("dept", ["eng", "sales"]), E.distinct_in_set("dept", ["eng", "sales", "hr"]),
            E.values_in_set("dept", ["eng", "sales"]), E.quantile_between("age", 0.5, 30, 40),
            E.columns_match(["name", "age", "salary", "dept"]), E.custom("anything"),
            E.column_type("age", "double"), E.custom("positive", "salary > age"),
        )
    )


def test_failing_cases(spark):
    x = column(spark, [1.0, None, 3.0])
    assert verdicts(x, E.not_null("x")) == [False]
    assert verdicts(column(spark, [1.0, 1.0, 2.0]), E.unique("x")) == [False]
    assert verdicts(column(spark, [1.0, 2.0, 100.0]), E.between("x", 0, 10)) == [False]
    many = column(spark, [float(i) for i in range(200)])
    assert verdicts(many, E.row_count_between(10, 100)) == [False]


@pytest.mark.parametrize("share,ok", [(0.0, True), (0.01, True), (0.02, True), (0.05, False), (0.5, False)])
def test_not_null_tolerance_is_a_share_of_the_rows(spark, share, ok):
    n = 1000
    values = [None] * int(n * share) + [1.0] * (n - int(n * share))
    assert verdicts(column(spark, values), E.not_null("x", 0.02)) == [ok]


def test_tolerance_is_not_lost_to_rounding(spark):
    # 0.29 * 100 is 28.999999999999996 in binary.
    values = [None] * 29 + [1.0] * 71
    assert verdicts(column(spark, values), E.not_null("x", 0.29)) == [True]


def test_null_is_one_distinct_value(spark):
    assert verdicts(column(spark, [1.0, 2.0, None]), E.unique("x")) == [True]
    assert verdicts(column(spark, [1.0, None, None]), E.unique("x")) == [False]


def test_nan_is_left_out(spark):
    x = column(spark, [1.0, float("nan"), 3.0])
    low, high, inside = check(x, E.min_between("x", 1, 1), E.max_between("x", 3, 3), E.between("x", 0, 5))
    assert low["success"] and high["success"] and inside["success"] and inside["total"] == 2


def test_regex_searches_anywhere_and_skips_nulls(spark):
    x = column(spark, ["abc", "xbx", None], "STRING")
    (r,) = check(x, E.match_regex("x", "b"))
    assert r["success"] and r["total"] == 3


def test_empty_table(spark):
    x = column(spark, [1.0]).where("1 = 0")
    got = check(
        x, E.not_null("x"), E.unique("x"), E.between("x", 0, 1), E.mean_between("x", 0, 1), E.stddev_between("x", 0, 1),
        E.min_between("x", 0, 1), E.max_between("x", 0, 1), E.quantile_between("x", 0.5, 0, 1), E.kl_less_than("x", 1.0),
        E.distinct_equal_set("x", ["1.0"]), E.values_in_set("x", ["1.0"]),
    )
    assert [r["success"] for r in got] == [True, True, True, False, False, False, False, False, False, False, True]


def test_single_value_has_no_sample_stddev(spark):
    assert verdicts(column(spark, [5.0]), E.stddev_between("x", 0, 10)) == [False]


@pytest.mark.parametrize("q,want", [(0.0, 1.0), (0.25, 2.0), (0.5, 3.0), (0.74, 4.0), (1.0, 5.0)])
def test_quantile_is_nearest_rank(spark, q, want):
    (r,) = check(column(spark, [5.0, 3.0, 1.0, 2.0, 4.0]), E.quantile_between("x", q, want, want))
    assert r["success"] and r["observed"] == want


def test_quantile_rounds_half_away_from_zero(spark):
    # (4 - 1) * 0.5 = 1.5 -> rank 2
    (r,) = check(column(spark, [10.0, 20.0, 30.0, 40.0]), E.quantile_between("x", 0.5, 0, 100))
    assert r["observed"] == 30.0


def test_kl_of_a_constant_column(spark):
    (r,) = check(column(spark, [7.0] * 100), E.kl_less_than("x", 100.0))
    # All mass in one of 10 bins next to the centre.
    bins = 10
    weights = [math.exp(-0.5 * (-2 + (i + 0.5) * 4 / bins) ** 2) for i in range(bins)]
    assert r["observed"] == pytest.approx(-math.log(weights[5] / sum(weights)), abs=1e-9)


def test_errors_are_recorded_and_the_rest_runs(people):
    got = check(
        people, E.not_null("gone"), E.between("name", 0, 1), E.match_regex("name", "("), E.custom("bad", "no_col > 1"),
        E.custom("number", "age + 1"), E.not_null("name"),
    )
    assert [r["success"] for r in got] == [False] * 5 + [True]
    assert all(r["exception"] for r in got[:5]) and got[5]["exception"] is None


def test_summary(people):
    results = run_suite(E.ExpectationSuite("s", [E.not_null("name"), E.between("age", 0, 1)]), people)
    (r,) = summarize(results).collect()
    assert (r["total"], r["passed"], r["failed"], r["success_percent"], r["success"]) == (2, 1, 1, 50.0, False)
    empty = run_suite(E.ExpectationSuite("none"), people)
    (r,) = summarize(empty, "none").collect()
    assert (r["total"], r["success_percent"], r["success"]) == (0, 100.0, True)


def test_failing_rows_are_whole(people):
    assert failing_rows(people, E.between("age", 30, 40)).count() == 2
    sides = {(r["value"], r["side"]) for r in failing_rows(people, E.distinct_equal_set("dept", ["eng", "hr"])).collect()}
    assert sides == {("sales", "extra"), ("hr", "missing")}


def test_suite_is_one_scan(people, tmp_path):
    path = str(tmp_path / "people")
    people.write.parquet(path)
    df = people.sparkSession.read.parquet(path)
    suite = E.ExpectationSuite(
        "s", [E.not_null("name"), E.between("age", 0, 100), E.mean_between("age", 0, 100), E.match_regex("dept", "."),
              E.values_in_set("dept", ["eng"]), E.custom("c", "salary > 0"), E.columns_match(["name"])]
    )
    plan = run_suite(suite, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_many_metrics_are_split(spark):
    from tablewatch.plans import suite as S

    df = spark.range(10).selectExpr(*[f"id + {i} AS c{i}" for i in range(120)])
    items = [E.between(f"c{i}", 0, 1000) for i in range(120)] + [E.mean_between(f"c{i}", 0, 1000) for i in range(120)]
    got = check(df, *items)
    assert len(got) == 240 and all(r["success"] for r in got)
    assert S.METRICS_PER_SCAN == 200


def test_a_large_set_is_joined(spark):
    rows = spark.createDataFrame([(k, float(k), f"n{k}") for k in [*range(50), 5_000, 5_000]] + [(None, None, None)], "i INT, d DOUBLE, s STRING")
    sets = [("i", range(2_000)), ("d", [str(k) for k in range(2_000)]), ("s", [f"n{k}" for k in range(2_000)] + ["n1"]), ("i", ["x", *range(1_500)])]
    checks = [E.values_in_set(column, values) for column, values in sets]
    got = run_suite(E.ExpectationSuite("s").add(*checks), rows).orderBy("position").collect()
    assert [(r["observed"], r["total"], r["success"]) for r in got] == [(2.0, 53, False)] * 4
    few = run_suite(E.ExpectationSuite("s").add(E.values_in_set("i", [1, 2])), rows).first()
    assert json.loads(got[0]["expected_json"])["allowed_set"][:2] == ["0", "1"] and json.loads(few["expected_json"])["allowed_set"] == ["1", "2"]
    assert [r["i"] for r in failing_rows(rows, checks[0]).collect()] == [5_000, 5_000]
    plan = run_suite(E.ExpectationSuite("s").add(checks[2]), rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and " IN (" not in plan and "INSET" not in plan
