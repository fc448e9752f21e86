"""Views, catalogs and members of odd types."""

import datetime
from decimal import Decimal

from pyspark.sql import types as T

from tablewatch.plans import monitors as M
from tablewatch.plans.members import members_of
from tablewatch.sources.inventory import catalog_tables


def test_members_take_the_column_type():
    assert members_of([1, "1", 1.0, 1.5, True, "x"], T.IntegerType()).values == [1]
    assert members_of([1, "1", 1.0, 1.5, True, "x"], T.IntegerType()).absent == ["1.5", "true", "x"]
    assert members_of([1, "2.5", 1e7], T.DoubleType()).values == [1.0, 2.5, 1e7]
    assert members_of([1.005, None], T.DecimalType(10, 2)).values == [Decimal("1.005")]
    assert members_of([True, "false", 1], T.BooleanType()).values == [True, False]
    assert members_of(["2024-02-30", "2024-02-29"], T.DateType()).values == [datetime.date(2024, 2, 29)]
    assert members_of([True, 7, "a"], T.StringType()).values == ["true", "7", "a"]
    assert members_of([300], T.ByteType()).absent == ["300"]


def test_custom_sql_puts_views_back(spark, people):
    spark.range(3).createOrReplaceTempView("people")
    cfg = M.CustomSql("c", "people", query="SELECT count(*) FROM people", expected=5.0, comparison="=")
    assert M.check_custom_sql({"people": people, "other": people}, cfg, "2024-01-01 00:00:00").first()["alert"] is False
    assert spark.table("people").count() == 3
    assert not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("people")


def test_catalog_tables_of_another_database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS elsewhere LOCATION '{tmp_path}'")
    spark.sql(f"CREATE TABLE elsewhere.t USING parquet LOCATION '{tmp_path}/t' AS SELECT 1 AS a")
    found = catalog_tables(spark, "elsewhere")
    assert found["t"].collect()[0]["a"] == 1
    spark.sql("DROP TABLE elsewhere.t")
    spark.sql("DROP DATABASE elsewhere")


def test_a_monitor_that_cannot_run_leaves_the_others(spark, people):
    cfgs = [
        M.Freshness("gone", "nowhere", max_age_seconds=60),
        M.CustomSql("bad", "people", query="SELECT nothing FROM people", expected=1.0, comparison="="),
        M.CustomSql("good", "people", query="SELECT count(*) FROM people", expected=5.0, comparison="="),
    ]
    got = {r["monitor_id"]: r for r in M.run_monitors(cfgs, {"people": people}, "2024-01-01 00:00:00").collect()}
    assert got["good"]["alert"] is False and got["good"]["score"] == 5.0
    assert got["gone"]["severity"] == got["bad"]["severity"] == "CRITICAL"
    assert "nowhere" in got["gone"]["message"] and got["bad"]["monitor_type"] == "error"
