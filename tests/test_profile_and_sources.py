import pytest

from tablewatch.plans import expectations as E
from tablewatch.plans.profile import profile
from tablewatch.plans.suggest import suggest, to_suite
from tablewatch.plans.suite import run_suite, summarize
from tablewatch.sources.files import from_pandas, inline, open_table, read_csv
from tablewatch.sources.inventory import execute_query, table_inventory
from tablewatch.sources.jdbc import JdbcSource, Split


def test_profile(people):
    rows = {r["column_name"]: r for r in profile(people, "people", "2024-01-01").collect()}
    age = rows["age"]
    assert (age["mean_val"], age["min_val"], age["max_val"], age["distinct_count"]) == (35.0, 25.0, 45.0, 5)
    assert age["quantiles"] == [25.0, 30.0, 35.0, 40.0, 45.0] and rows["name"]["mean_val"] is None


def test_profile_nulls_and_single_rows(spark):
    (r,) = profile(spark.createDataFrame([(1.0,), (None,), (3.0,), (None,), (5.0,)], "x DOUBLE"), "t").collect()
    assert (r["null_count"], r["row_count"], r["distinct_count"]) == (2, 5, 4)
    (r,) = profile(spark.createDataFrame([(1.0,)], "x DOUBLE"), "t").collect()
    assert r["stddev_val"] == 0.0
    (r,) = profile(spark.createDataFrame([(1.0,)], "x DOUBLE").where("1 = 0"), "t").collect()
    assert r["row_count"] == 0 and r["stddev_val"] is None and r["quantiles"] is None


def test_approximate_distinct(people):
    got = profile(people, "people", approx_distinct=0.01).collect()
    assert {r["distinct_count"] for r in got if r["column_name"] == "name"} == {5}


def test_suggestions(spark):
    df = spark.createDataFrame([(i, float(-i), i % 2) for i in range(1, 31)] + [(31, None, 1)], "id INT, x DOUBLE, flag INT")
    got = suggest(profile(df, "t"), df).collect()
    kinds = {(r["column_name"], r["expectation"]) for r in got}
    assert ("id", E.UNIQUE) in kinds and ("x", E.NOT_NULL) in kinds and ("flag", E.VALUES_IN_SET) in kinds
    assert [r["values"] for r in got if r["expectation"] == E.VALUES_IN_SET] == [["0", "1"]]
    (null,) = [r for r in got if r["expectation"] == E.NOT_NULL]
    assert null["confidence"] == pytest.approx(0.9 - 5 / 31)
    (mean,) = [r for r in got if r["column_name"] == "x" and r["expectation"] == E.MEAN_BETWEEN]
    assert mean["min_value"] < mean["max_value"]
    assert summarize(run_suite(to_suite("s", suggest(profile(df, "t"), df)), df)).first()["success"]


def test_files(spark, tmp_path, people):
    path = str(tmp_path / "p")
    people.write.option("header", True).csv(path)
    assert read_csv(spark, path).dtypes[1] == ("age", "double")
    assert open_table(spark, "csv", path, schema="a STRING, b INT, c DOUBLE, d STRING").dtypes[1] == ("b", "int")
    assert from_pandas(spark, people.toPandas()).count() == 5
    assert inline(spark, [(1, "a")], "x INT, y STRING").count() == 1
    with pytest.raises(ValueError):
        open_table(spark, "toml", path)


def test_inventory(spark, people):
    rows = table_inventory(spark, {"people": people}).orderBy("ordinal").collect()
    assert [(r["column_name"], r["row_count"]) for r in rows][:2] == [("name", 5), ("age", 5)]
    people.createOrReplaceTempView("people_view")
    assert execute_query(spark, "SELECT * FROM people_view WHERE age > 30").row_count == 3


def test_jdbc_options():
    src = JdbcSource("jdbc:postgresql://db/x", {"user": "u"})
    options = src.options("public", "orders", Split("id", 0, 1000, 8))
    assert options["dbtable"] == '"public"."orders"' and options["numPartitions"] == "8"
    for bad in ("", "a b", 'x"; DROP', "a" * 64):
        with pytest.raises(ValueError):
            src.options("public", bad)
