"""Queries on rows that need care: typed sets, lost budgets, answers of many rows, missing times, bad records, far values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.operators.histogram import histogram
from tablewatch.operators.local_rows import union_all
from tablewatch.plans import expectations as E
from tablewatch.plans import incidents as I
from tablewatch.plans import monitors as M
from tablewatch.plans.importers import airflow
from tablewatch.plans.suite import failing_rows, run_suite

from .common import AS_OF, AS_OF_SQL, flat_monitor, monitor_sql, r, table
from .suites import row

UNION = "\nUNION ALL\n"

_TYPED = """SELECT o_orderstatus = 'O' AS is_open, CAST(o_custkey % 3 AS DOUBLE) AS third, CAST(o_custkey % 4 AS INT) AS fourth,
  CAST(date_trunc('year', o_orderdate) AS DATE) AS opened FROM orders"""


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.to_date(F.date_trunc("year", "o_orderdate"))
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderstatus") == "O").alias("is_open"), (F.col("o_custkey") % 3).cast("double").alias("third"),
        (F.col("o_custkey") % 4).cast("int").alias("fourth"), year.alias("opened"),
    )


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members are compared as values of the column's type, not as text."""
    years = [f"{y}-01-01" for y in range(1992, 1997)]
    suite = E.ExpectationSuite("typed").add(
        E.values_in_set("is_open", [True, False]), E.values_in_set("third", [0, 1]), E.distinct_equal_set("third", [0, 1, 2, 2.0]),
        E.distinct_in_set("fourth", ["0", 1.0, 2]), E.distinct_equal_set("fourth", [0, 1, 2, 3, 3.5]),
        E.values_in_set("opened", years), E.distinct_equal_set("is_open", ["true", False, "maybe"]),
    )
    return run_suite(suite, _typed(spark, sf_dir)).select(
        "suite", "position", "expectation", F.col("column").alias("column_name"), "success", r("observed").alias("observed"), "total"
    )


def _set_row(position: int, kind: str, column: str, observed: str) -> str:
    source = f"(SELECT {observed} AS o, count(*) AS n FROM ({_TYPED}))"
    return row("typed", position, kind, column, "o = 0", "o", "n", source)


_SETS_SQL = UNION.join(
    (
        _set_row(0, E.VALUES_IN_SET, "is_open", "count_if(is_open IS NOT NULL AND is_open NOT IN (true, false))"),
        _set_row(1, E.VALUES_IN_SET, "third", "count_if(third NOT IN (0.0, 1.0))"),
        _set_row(2, E.DISTINCT_EQUAL_SET, "third", "abs(3 - count(DISTINCT third))"),
        _set_row(3, E.DISTINCT_IN_SET, "fourth", "count(DISTINCT fourth) FILTER (fourth NOT IN (0, 1, 2))"),
        _set_row(4, E.DISTINCT_EQUAL_SET, "fourth", "1 + 4 - count(DISTINCT fourth)"),
        _set_row(5, E.VALUES_IN_SET, "opened", "count_if(year(opened) NOT BETWEEN 1992 AND 1996)"),
        _set_row(6, E.DISTINCT_EQUAL_SET, "is_open", "1 + 2 - count(DISTINCT is_open)"),
    )
)


def _set_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values behind a failed distinct check, on both sides."""
    return failing_rows(_typed(spark, sf_dir), E.distinct_equal_set("fourth", [0, 2, 7, 3.5]))


_SET_VALUES_SQL = f"""
SELECT DISTINCT CAST(fourth AS VARCHAR) AS value, 'extra' AS side FROM ({_TYPED}) WHERE fourth NOT IN (0, 2, 7)
UNION ALL
SELECT v, 'missing' FROM (VALUES ('0'), ('2'), ('7'), ('3.5')) t(v) WHERE v NOT IN (SELECT CAST(fourth AS VARCHAR) FROM ({_TYPED}))"""


def _cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier has no budget and is told so."""
    usage = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.round("l_extendedprice", 0).alias("cost"))
    budgets = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select("s_suppkey", F.lit(1e6).alias("budget"))
    cfg = M.Cost("cost", "lineitem", resource="storage_cost", resource_column="s_suppkey")
    return flat_monitor(M.check_cost(usage, cfg, AS_OF, budgets), 2)


_COST_SQL = monitor_sql(
    """(SELECT l_suppkey AS k, sum(round(l_extendedprice, 0)) AS c, CASE WHEN l_suppkey % 3 <> 0 THEN 1e6 END AS b
  FROM lineitem GROUP BY 1, 3)""",
    monitor_id="'cost:' || k", kind="cost", table_name="lineitem", alert="coalesce(c > b, false)", critical="c / b > 2", score="c",
    threshold="b", digits=2, ts=AS_OF_SQL,
    message="""CASE WHEN c > b THEN printf('Cost alert: storage_cost cost=%.2f exceeds budget=%.2f (x%.1f)', c, b, c / b)
  WHEN b IS NULL THEN printf('Cost: storage_cost cost=%.2f has no budget', c)
  ELSE printf('Cost OK: storage_cost cost=%.2f within budget=%.2f', c, b) END""",
)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that answer with one row, with several and with none."""
    tables = {"orders": table(spark, sf_dir, "orders")}
    asked = {
        "one": "SELECT max(o_custkey) FROM orders", "many": "SELECT o_totalprice FROM orders ORDER BY o_totalprice",
        "none": "SELECT o_totalprice FROM orders WHERE o_orderkey < 0",
    }
    cfgs = [M.CustomSql(f"sql-{k}", "orders", query=q, expected=0.0, comparison="<") for k, q in asked.items()]
    return flat_monitor(union_all([M.check_custom_sql(tables, c, AS_OF) for c in cfgs]), 3)


_ANSWERS_SQL = UNION.join(
    monitor_sql(
        source, monitor_id=f"'sql-{name}'", kind="custom_sql", table_name="orders", alert="n <> 1", critical="false", score="o", digits=3,
        threshold="0.0", ts=AS_OF_SQL,
        message="CASE WHEN n <> 1 THEN printf('Custom SQL alert: the query gave %d rows, one is expected', n) "
                "ELSE printf('Custom SQL OK: observed=%.4f', CAST(o AS DOUBLE)) END",
    )
    for name, source in (
        ("one", "(SELECT 1 AS n, max(o_custkey) AS o FROM orders)"), ("many", "(SELECT count(*) AS n, NULL::DOUBLE AS o FROM orders)"),
        ("none", "(SELECT 0 AS n, NULL::DOUBLE AS o)"),
    )
)


def _untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth event has no time: it is kept, and the others are judged without it."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    return I.mark_duplicates(events, "event_type", "ts", "event_id", 3600).select("event_id", "event_type", "duplicate")


_UNTIMED_SQL = """
WITH RECURSIVE ev AS (SELECT event_id, event_type AS k, ts FROM events WHERE event_id % 10 <> 0),
chain AS (
  SELECT k, min(ts) AS ts FROM ev GROUP BY 1
  UNION ALL
  SELECT c.k, (SELECT min(e.ts) FROM ev e WHERE e.k = c.k AND e.ts >= c.ts + INTERVAL 3600 SECOND) FROM chain c
  WHERE c.ts IS NOT NULL)
SELECT event_id, k AS event_type, NOT EXISTS (SELECT 1 FROM chain c WHERE c.k = ev.k AND c.ts = ev.ts) AS duplicate FROM ev
UNION ALL
SELECT event_id, event_type, false FROM events WHERE event_id % 10 = 0"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    good = F.format_string('{"dag_id": "load_%s", "state": "success", "execution_date": "2024-01-05T10:00:00Z"}', F.col("event_type"))
    text = (
        F.when(k % 5 == 0, F.lit('{"dag_id": "load_x", "state": "success", "execution_date": "2024-13-45T10:00:00Z"}'))
        .when(k % 5 == 1, F.lit("{broken"))
        .when(k % 5 == 2, F.lit('{"state": "failed"}'))
        .when(k % 5 == 3, F.lit(None).cast("string"))
        .otherwise(good)
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("payload"))


def _bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline events: a bad date is a missing date, and what cannot be read is counted by its reason."""
    rows = _payloads(spark, sf_dir)
    read = airflow.events(rows).groupBy(F.when(F.col("execution_date").isNull(), "no date").otherwise("read").alias("what"))
    lost = airflow.rejected(rows).groupBy(F.col("reason").alias("what"))
    return read.agg(F.count(F.lit(1)).alias("n")).unionByName(lost.agg(F.count(F.lit(1)).alias("n")))


_BAD_RECORDS_SQL = """
SELECT CASE event_id % 5 WHEN 0 THEN 'no date' WHEN 1 THEN 'not JSON' WHEN 2 THEN 'no dag_id' WHEN 3 THEN 'empty' ELSE 'read' END AS what,
  count(*) AS n FROM events GROUP BY 1"""


def _limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given limits, with values 10^12 and more beyond them on either side."""
    price = F.col("o_totalprice")
    far = F.when(F.col("o_orderkey") % 7 == 0, price * 1e12).when(F.col("o_orderkey") % 7 == 1, price * -1e12).otherwise(price)
    cells = histogram(table(spark, sf_dir, "orders").select(far.alias("v")), "v", 4, 0.0, 400_000.0)
    return cells.select("bin", r("bin_low", 2).alias("bin_low"), "count", r("share", 9).alias("share"))


_LIMITS_SQL = """
SELECT CAST(g.i AS INTEGER) AS bin, g.i * 100000.0::DOUBLE AS bin_low, count(v) AS count,
  round(count(v) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 9) AS share
FROM (SELECT unnest(range(4)) AS i) g LEFT JOIN (
  SELECT greatest(0, least(3, floor(CASE o_orderkey % 7 WHEN 0 THEN 1e9 WHEN 1 THEN -1e9 ELSE o_totalprice END / 100000))) AS v FROM orders) ON v = g.i
GROUP BY g.i"""

QUERIES = {
    "exp_sets_typed": _sets,
    "exp_set_failing_values": _set_values,
    "mon_cost_unbudgeted": _cost,
    "mon_custom_sql_rows": _answers,
    "incident_dedup_null_time": _untimed,
    "airflow_bad_rows": _bad_records,
    "stat_histogram_limits": _limits,
}
ORACLE = {
    "exp_sets_typed": _SETS_SQL,
    "exp_set_failing_values": _SET_VALUES_SQL,
    "mon_cost_unbudgeted": _COST_SQL,
    "mon_custom_sql_rows": _ANSWERS_SQL,
    "incident_dedup_null_time": _UNTIMED_SQL,
    "airflow_bad_rows": _BAD_RECORDS_SQL,
    "stat_histogram_limits": _LIMITS_SQL,
}
