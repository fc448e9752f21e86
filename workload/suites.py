"""Expectations on the test tables: for most kinds one that holds and one that fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.operators.local_rows import union_all
from tablewatch.plans import expectations as E
from tablewatch.plans.suite import failing_rows, run_suite, summarize

from .common import injected_sql, r, table

Query = Callable[[SparkSession, str], DataFrame]


def _flat(results: DataFrame, digits: int = 6) -> DataFrame:
    return results.select(
        "suite", "position", "expectation", F.col("column").alias("column_name"), "success",
        r("observed", digits).alias("observed"), "total",
    )


def suite_query(*parts: tuple[str, list[E.Expectation]], digits: int = 6) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return union_all(
            [
                _flat(run_suite(E.ExpectationSuite(name, list(items)), table(spark, sf_dir, name)), digits)
                for name, items in parts
            ]
        )

    return run


def row(
    suite: str, position: int, kind: str, column: str | None, success: str, observed: str | None,
    total: str | None, source: str, digits: int = 6,
) -> str:
    text = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    seen = f"round(CAST({observed} AS DOUBLE), {digits})" if observed else "CAST(NULL AS DOUBLE)"
    size = f"CAST({total} AS BIGINT)" if total else "CAST(NULL AS BIGINT)"
    return (
        f"SELECT '{suite}' AS suite, {position} AS position, '{kind}' AS expectation, {text} AS column_name, "
        f"{success} AS success, {seen} AS observed, {size} AS total FROM {source}"
    )


def rows(*selects: str) -> str:
    return "\nUNION ALL\n".join(selects)


def _kl_sql(column: str, source: str, limit: float, position: int) -> str:
    """KL divergence of a column from the fitted normal, bins by their edges."""
    return f"""
SELECT '{source}' AS suite, {position} AS position, 'column_kl_divergence_less_than' AS expectation,
  '{column}' AS column_name, kl <= {limit} AS success, round(kl, 6) AS observed, n AS total
FROM (
  SELECT sum(CASE WHEN o > 0 THEN p * ln(p / e) ELSE 0 END) AS kl, max(n) AS n
  FROM (
    SELECT o, n, o / sum(o) OVER () AS p, d / sum(d) OVER () AS e
    FROM (
      SELECT g.i, any_value(s.n) AS n, count(v.x) AS o,
        any_value(exp(-0.5 * power(-2.0 + (g.i + 0.5) * 4.0 / s.bins, 2))) AS d
      FROM (SELECT *, least(100, greatest(10, CAST(round(sqrt(n)) AS INTEGER))) AS bins FROM (
              SELECT count({column}) AS n, avg({column}) AS m, greatest(stddev_pop({column}), 1e-10) AS sd
              FROM {source})) s
      JOIN (SELECT unnest(range(100)) AS i) g ON g.i < s.bins
      LEFT JOIN (SELECT CAST({column} AS DOUBLE) AS x FROM {source}) v
        ON floor((v.x - (s.m - 2.0 * s.sd)) / (4.0 * s.sd / s.bins)) = g.i
      GROUP BY g.i
    )
  )
)"""


def _rank_sql(column: str, source: str, q: float) -> str:
    """Nearest-rank quantile, half away from zero."""
    return (
        f"(SELECT x FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS i, "
        f"count(*) OVER () AS n FROM {source} WHERE {column} IS NOT NULL) "
        f"WHERE i = CAST(floor((n - 1) * {q} + 0.5) AS BIGINT))"
    )


L, O, C, EV = "lineitem", "orders", "customer", "events"
OG, LB, CB, EN = "orders_gaps", "lineitem_bad", "customer_bad", "events_nan"
OGS, LBS, CBS, ENS = (injected_sql(n) for n in (OG, LB, CB, EN))
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

CONTRACT = [
    E.not_null("l_orderkey"),
    E.between("l_discount", 0, 0.1),
    E.between("l_quantity", 1, 50),
    E.row_count_between(1, 10_000_000_000),
    E.mean_between("l_quantity", 20, 30),
    E.match_regex("l_returnflag", "^[ANR]$"),
    E.values_in_set("l_linestatus", ["O", "F"]),
]
CONTRACT_SQL = rows(
    row(L, 0, E.NOT_NULL, "l_orderkey", "count_if(l_orderkey IS NULL) = 0", "count_if(l_orderkey IS NULL)", "count(*)", L),
    row(L, 1, E.BETWEEN, "l_discount", "count_if(l_discount < 0 OR l_discount > 0.1) = 0",
        "count_if(l_discount < 0 OR l_discount > 0.1)", "count(l_discount)", L),
    row(L, 2, E.BETWEEN, "l_quantity", "count_if(l_quantity < 1 OR l_quantity > 50) = 0",
        "count_if(l_quantity < 1 OR l_quantity > 50)", "count(l_quantity)", L),
    row(L, 3, E.ROW_COUNT_BETWEEN, None, "count(*) BETWEEN 1 AND 10000000000", "count(*)", "count(*)", L),
    row(L, 4, E.MEAN_BETWEEN, "l_quantity", "avg(l_quantity) BETWEEN 20 AND 30", "avg(l_quantity)", "count(l_quantity)", L),
    row(L, 5, E.MATCH_REGEX, "l_returnflag", "count_if(NOT regexp_matches(l_returnflag, '^[ANR]$')) = 0",
        "count_if(NOT regexp_matches(l_returnflag, '^[ANR]$'))", "count(*)", L),
    row(L, 6, E.VALUES_IN_SET, "l_linestatus", "count_if(l_linestatus NOT IN ('O', 'F')) = 0",
        "count_if(l_linestatus NOT IN ('O', 'F'))", "count(*)", L),
)

# A wide suite of every kind, for the summary and the benchmark.
EVERYTHING = [
    *CONTRACT,
    E.stddev_between("l_quantity", 10, 20),
    E.min_between("l_quantity", 1, 1),
    E.max_between("l_quantity", 1, 49),
    E.not_match_regex("l_returnflag", "N"),
    E.unique("l_orderkey"),
    E.distinct_equal_set("l_returnflag", ["A", "N", "R"]),
    E.distinct_in_set("l_linestatus", ["F"]),
    E.quantile_between("l_quantity", 0.5, 20, 30),
    E.kl_less_than("l_extendedprice", 5.0),
    E.columns_match(LINE_COLUMNS),
    E.column_type("l_quantity", "double"),
    E.column_type("l_quantity", "string"),
    E.custom("net_price", "l_extendedprice * (1 - l_discount) > 0"),
    E.not_null("no_such_column"),
]


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    suite = E.ExpectationSuite("contract", list(EVERYTHING))
    return summarize(run_suite(suite, table(spark, sf_dir, L)))


_SUMMARY_SQL = """
WITH c AS (
  SELECT count(*) AS n, count_if(l_orderkey IS NULL) AS nulls,
    count_if(l_discount < 0 OR l_discount > 0.1) AS disc, count_if(l_quantity < 1 OR l_quantity > 50) AS qty,
    avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd, min(l_quantity) AS lo, max(l_quantity) AS hi,
    count_if(l_returnflag NOT IN ('A', 'N', 'R')) AS rf, count_if(l_linestatus NOT IN ('O', 'F')) AS ls,
    count_if(contains(l_returnflag, 'N')) AS hasn, count(DISTINCT l_orderkey) AS dk,
    count(DISTINCT l_returnflag) AS drf, count(DISTINCT l_linestatus) AS dls,
    count_if(NOT (l_extendedprice * (1 - l_discount) > 0)) AS net
  FROM lineitem),
t AS (
  SELECT 21 AS total,
    CAST(nulls = 0 AS INT) + CAST(disc = 0 AS INT) + CAST(qty = 0 AS INT) + 1
    + CAST(m BETWEEN 20 AND 30 AS INT) + CAST(rf = 0 AS INT) + CAST(ls = 0 AS INT)
    + CAST(sd BETWEEN 10 AND 20 AS INT) + CAST(lo = 1 AS INT) + CAST(hi BETWEEN 1 AND 49 AS INT)
    + CAST(hasn = 0 AS INT) + CAST(dk = n AS INT) + CAST(drf = 3 AND rf = 0 AS INT) + CAST(dls = 1 AND ls = 0 AS INT)
    + CAST(""" + _rank_sql("l_quantity", "lineitem", 0.5) + """ BETWEEN 20 AND 30 AS INT)
    + 1 + 1 + 1 + 0 + CAST(net = 0 AS INT) + 0 AS passed
  FROM c)
SELECT 'contract' AS suite, CAST(total AS BIGINT) AS total, CAST(passed AS BIGINT) AS passed,
  CAST(total - passed AS BIGINT) AS failed, round(passed * 100.0 / total, 6) AS success_percent,
  total = passed AS success FROM t"""


def _failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offending rows and values behind three failed expectations, counted per kind and value."""
    low = failing_rows(table(spark, sf_dir, LB), E.between("qty_bad", 1, 50)).select(
        F.lit("between").alias("kind"), F.col("l_partkey").cast("string").alias("value")
    )
    extra = failing_rows(
        table(spark, sf_dir, O), E.distinct_equal_set("o_orderpriority", ["1-URGENT", "2-HIGH", "6-NONE"])
    ).select(F.col("side").alias("kind"), "value")
    twice = failing_rows(table(spark, sf_dir, EV), E.unique("user_id")).select(
        F.lit("unique").alias("kind"), F.col("user_id").cast("string").alias("value")
    )
    return union_all([low, extra, twice]).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


_FAILING_SQL = f"""
SELECT kind, value, count(*) AS n FROM (
  SELECT 'between' AS kind, CAST(l_partkey AS VARCHAR) AS value FROM {LBS} WHERE qty_bad < 1 OR qty_bad > 50
  UNION ALL
  SELECT DISTINCT 'extra', o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '6-NONE')
  UNION ALL
  SELECT 'missing', v FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('6-NONE')) t(v)
  WHERE v NOT IN (SELECT o_orderpriority FROM orders)
  UNION ALL
  SELECT 'unique', CAST(user_id AS VARCHAR) FROM events GROUP BY user_id HAVING count(*) > 1
) GROUP BY kind, value"""

BAD_QTY = "count_if(qty_bad < 1 OR qty_bad > 50)"
BAD_NAME = "count_if(NOT regexp_matches(name_bad, '^Customer#[0-9]{9}$'))"
REGEX = "^Customer#[0-9]{9}$"

QUERIES: dict[str, Query] = {
    "exp_contract": suite_query((L, CONTRACT)),
    "exp_not_null": suite_query(
        (OG, [E.not_null("o_totalprice"), E.not_null("price_gap", 0.01), E.not_null("price_gap", 0.021)])
    ),
    "exp_unique": suite_query((OG, [E.unique("o_orderkey"), E.unique("key_gap"), E.unique("o_custkey")])),
    "exp_between": suite_query(
        (LB, [E.between("l_quantity", 1, 50), E.between("qty_bad", 1, 50), E.between("price_gap", None, 200_000)]),
        (EN, [E.between("value_nan", 0, None)]),
    ),
    "exp_row_count": suite_query(
        (O, [E.row_count_between(1, None), E.row_count_between(None, 10)]),
    ),
    "exp_mean": suite_query(
        (LB, [E.mean_between("l_quantity", 20, 30), E.mean_between("price_gap", 0, 1000)]),
        (EN, [E.mean_between("value_nan", 0, 1000)]),
        digits=3,
    ),
    "exp_stddev": suite_query(
        (LB, [E.stddev_between("l_quantity", 10, 20), E.stddev_between("qty_bad", 0, 1)])
    ),
    "exp_min": suite_query((LB, [E.min_between("l_quantity", 1, 1), E.min_between("qty_bad", 0, 1)])),
    "exp_max": suite_query(
        (LB, [E.max_between("l_discount", 0, 0.1)]), (EN, [E.max_between("value_nan", 0, 1)])
    ),
    "exp_match_regex": suite_query((CB, [E.match_regex("c_name", REGEX), E.match_regex("name_bad", REGEX)])),
    "exp_not_match_regex": suite_query(
        (CB, [E.not_match_regex("c_name", "bad"), E.not_match_regex("name_bad", "^b[a-z]d$")])
    ),
    "exp_distinct_equal_set": suite_query(
        (L, [E.distinct_equal_set("l_returnflag", ["A", "N", "R"]),
             E.distinct_equal_set("l_returnflag", ["A", "N", "X", "Y"])])
    ),
    "exp_distinct_in_set": suite_query(
        (O, [E.distinct_in_set("o_orderstatus", ["F", "O", "P", "Q"]),
             E.distinct_in_set("o_orderpriority", ["1-URGENT", "2-HIGH"])])
    ),
    "exp_values_in_set": suite_query(
        (O, [E.values_in_set("o_orderstatus", ["F", "O", "P"]),
             E.values_in_set("o_orderpriority", ["1-URGENT", "2-HIGH"])])
    ),
    "exp_kl_divergence": suite_query(
        (L, [E.kl_less_than("l_extendedprice", 5.0)]), (C, [E.kl_less_than("c_acctbal", 0.01)]),
    ),
    "exp_quantile": suite_query(
        (L, [E.quantile_between("l_quantity", 0.5, 20, 30), E.quantile_between("l_extendedprice", 0.9, 0, 1000),
             E.quantile_between("l_discount", 0.0, 0, 0)])
    ),
    "exp_columns_ordered": suite_query(
        (L, [E.columns_match(LINE_COLUMNS), E.columns_match(LINE_COLUMNS[::-1]), E.row_count_between(1, None)])
    ),
    "exp_custom_expr": suite_query(
        (L, [E.custom("net", "l_extendedprice * (1 - l_discount) > 0"), E.custom("cheap", "l_extendedprice < 50000"),
             E.custom("named only")])
    ),
    "exp_column_type": suite_query(
        (O, [E.column_type("o_orderkey", "bigint"), E.column_type("o_orderkey", "string"),
             E.column_exists("o_custkey"), E.column_exists("gone"), E.row_count_between(1, None)])
    ),
    "exp_values_in_large_set": suite_query(
        (O, [E.values_in_set("o_custkey", range(1, 1_400)), E.values_in_set("o_orderkey", [str(k) for k in range(0, 40_000, 2)]),
             E.values_in_set("o_orderpriority", [f"{k}-LOW" for k in range(3_000)])])
    ),
    "exp_errors": suite_query(
        (O, [E.not_null("gone"), E.between("o_orderstatus", 0, 1), E.custom("typo", "o_total > 0"),
             E.match_regex("o_orderstatus", "("), E.not_null("o_orderkey"), E.custom("zero", "o_totalprice / (o_orderkey % 2) > 0"),
             E.custom("positive", "o_totalprice > 0"), E.custom("number", "CAST(o_orderstatus AS INT) > 0")])
    ),
    "suite_summary": _summary,
    "exp_failing_rows": _failing,
}
# The summary rounds like its SQL.
QUERIES["suite_summary"] = lambda spark, sf_dir: _summary(spark, sf_dir).withColumn(
    "success_percent", r("success_percent")
)

ORACLE: dict[str, str] = {
    "exp_contract": CONTRACT_SQL,
    "exp_not_null": rows(
        row(OG, 0, E.NOT_NULL, "o_totalprice", "count_if(o_totalprice IS NULL) = 0", "count_if(o_totalprice IS NULL)", "count(*)", OGS),
        row(OG, 1, E.NOT_NULL, "price_gap", "count_if(price_gap IS NULL) <= floor(round(0.01 * count(*), 9))",
            "count_if(price_gap IS NULL)", "count(*)", OGS),
        row(OG, 2, E.NOT_NULL, "price_gap", "count_if(price_gap IS NULL) <= floor(round(0.021 * count(*), 9))",
            "count_if(price_gap IS NULL)", "count(*)", OGS),
    ),
    "exp_unique": rows(
        *[
            row(OG, i, E.UNIQUE, c, f"count(DISTINCT {c}) + max(CAST({c} IS NULL AS INT)) = count(*)",
                f"count(*) - count(DISTINCT {c}) - max(CAST({c} IS NULL AS INT))", "count(*)", OGS)
            for i, c in enumerate(("o_orderkey", "key_gap", "o_custkey"))
        ]
    ),
    "exp_between": rows(
        row(LB, 0, E.BETWEEN, "l_quantity", "count_if(l_quantity < 1 OR l_quantity > 50) = 0",
            "count_if(l_quantity < 1 OR l_quantity > 50)", "count(l_quantity)", LBS),
        row(LB, 1, E.BETWEEN, "qty_bad", f"{BAD_QTY} = 0", BAD_QTY, "count(qty_bad)", LBS),
        row(LB, 2, E.BETWEEN, "price_gap", "count_if(price_gap > 200000) = 0", "count_if(price_gap > 200000)", "count(price_gap)", LBS),
        row(EN, 0, E.BETWEEN, "value_nan", "count_if(NOT isnan(value_nan) AND value_nan < 0) = 0",
            "count_if(NOT isnan(value_nan) AND value_nan < 0)", "count_if(NOT isnan(value_nan))", ENS),
    ),
    "exp_row_count": rows(
        row(O, 0, E.ROW_COUNT_BETWEEN, None, "count(*) >= 1", "count(*)", "count(*)", O),
        row(O, 1, E.ROW_COUNT_BETWEEN, None, "count(*) <= 10", "count(*)", "count(*)", O),
    ),
    "exp_mean": rows(
        row(LB, 0, E.MEAN_BETWEEN, "l_quantity", "avg(l_quantity) BETWEEN 20 AND 30", "avg(l_quantity)", "count(l_quantity)", LBS, 3),
        row(LB, 1, E.MEAN_BETWEEN, "price_gap", "avg(price_gap) BETWEEN 0 AND 1000", "avg(price_gap)", "count(price_gap)", LBS, 3),
        row(EN, 0, E.MEAN_BETWEEN, "value_nan", "avg(value) FILTER (event_id % 500 <> 0) BETWEEN 0 AND 1000",
            "avg(value) FILTER (event_id % 500 <> 0)", "count_if(event_id % 500 <> 0)", EV, 3),
    ),
    "exp_stddev": rows(
        row(LB, 0, E.STDDEV_BETWEEN, "l_quantity", "stddev_samp(l_quantity) BETWEEN 10 AND 20", "stddev_samp(l_quantity)", "count(l_quantity)", LBS),
        row(LB, 1, E.STDDEV_BETWEEN, "qty_bad", "stddev_samp(qty_bad) BETWEEN 0 AND 1", "stddev_samp(qty_bad)", "count(qty_bad)", LBS),
    ),
    "exp_min": rows(
        row(LB, 0, E.MIN_BETWEEN, "l_quantity", "min(l_quantity) BETWEEN 1 AND 1", "min(l_quantity)", "count(l_quantity)", LBS),
        row(LB, 1, E.MIN_BETWEEN, "qty_bad", "min(qty_bad) BETWEEN 0 AND 1", "min(qty_bad)", "count(qty_bad)", LBS),
    ),
    "exp_max": rows(
        row(LB, 0, E.MAX_BETWEEN, "l_discount", "max(l_discount) BETWEEN 0 AND 0.1", "max(l_discount)", "count(l_discount)", LBS),
        row(EN, 0, E.MAX_BETWEEN, "value_nan", "max(value) FILTER (event_id % 500 <> 0) BETWEEN 0 AND 1",
            "max(value) FILTER (event_id % 500 <> 0)", "count_if(event_id % 500 <> 0)", EV),
    ),
    "exp_match_regex": rows(
        row(CB, 0, E.MATCH_REGEX, "c_name", f"count_if(NOT regexp_matches(c_name, '{REGEX}')) = 0",
            f"count_if(NOT regexp_matches(c_name, '{REGEX}'))", "count(*)", CBS),
        row(CB, 1, E.MATCH_REGEX, "name_bad", f"{BAD_NAME} = 0", BAD_NAME, "count(*)", CBS),
    ),
    "exp_not_match_regex": rows(
        row(CB, 0, E.NOT_MATCH_REGEX, "c_name", "count_if(regexp_matches(c_name, 'bad')) = 0",
            "count_if(regexp_matches(c_name, 'bad'))", "count(*)", CBS),
        row(CB, 1, E.NOT_MATCH_REGEX, "name_bad", "count_if(regexp_matches(name_bad, '^b[a-z]d$')) = 0",
            "count_if(regexp_matches(name_bad, '^b[a-z]d$'))", "count(*)", CBS),
    ),
    "exp_distinct_equal_set": rows(
        *[
            row(L, i, E.DISTINCT_EQUAL_SET, "l_returnflag",
                f"count_if(v NOT IN ({s})) = 0 AND count_if(v IN ({s})) = {n}",
                f"count_if(v NOT IN ({s})) + {n} - count_if(v IN ({s}))", "sum(c)",
                "(SELECT l_returnflag AS v, count(*) AS c FROM lineitem GROUP BY 1)")
            for i, (s, n) in enumerate((("'A', 'N', 'R'", 3), ("'A', 'N', 'X', 'Y'", 4)))
        ]
    ),
    "exp_distinct_in_set": rows(
        *[
            row(O, i, E.DISTINCT_IN_SET, c, f"count_if(v NOT IN ({s})) = 0", f"count_if(v NOT IN ({s}))", "sum(c)",
                f"(SELECT {c} AS v, count(*) AS c FROM orders GROUP BY 1)")
            for i, (c, s) in enumerate(
                (("o_orderstatus", "'F', 'O', 'P', 'Q'"), ("o_orderpriority", "'1-URGENT', '2-HIGH'"))
            )
        ]
    ),
    "exp_values_in_set": rows(
        *[
            row(O, i, E.VALUES_IN_SET, c, f"count_if({c} NOT IN ({s})) = 0", f"count_if({c} NOT IN ({s}))", "count(*)", O)
            for i, (c, s) in enumerate(
                (("o_orderstatus", "'F', 'O', 'P'"), ("o_orderpriority", "'1-URGENT', '2-HIGH'"))
            )
        ]
    ),
    "exp_kl_divergence": rows(
        _kl_sql("l_extendedprice", L, 5.0, 0), _kl_sql("c_acctbal", C, 0.01, 0)
    ),
    "exp_quantile": rows(
        *[
            f"SELECT 'lineitem' AS suite, {i} AS position, 'column_quantile_between' AS expectation, "
            f"'{c}' AS column_name, x BETWEEN {lo} AND {hi} AS success, round(x, 6) AS observed, n AS total "
            f"FROM (SELECT {_rank_sql(c, L, q)} AS x, count({c}) AS n FROM lineitem)"
            for i, (c, q, lo, hi) in enumerate(
                (("l_quantity", 0.5, 20, 30), ("l_extendedprice", 0.9, 0, 1000), ("l_discount", 0.0, 0, 0))
            )
        ]
    ),
    "exp_columns_ordered": rows(
        *[
            row(L, i, E.COLUMNS_ORDERED, None,
                f"list(column_name ORDER BY column_index) = {cols}", None, None,
                "(SELECT column_name, column_index FROM duckdb_columns() WHERE table_name = 'lineitem')")
            for i, cols in enumerate((LINE_COLUMNS, LINE_COLUMNS[::-1]))
        ],
        row(L, 2, E.ROW_COUNT_BETWEEN, None, "count(*) >= 1", "count(*)", "count(*)", L),
    ),
    "exp_custom_expr": rows(
        row(L, 0, E.CUSTOM, None, "count_if(NOT (l_extendedprice * (1 - l_discount) > 0)) = 0",
            "count_if(NOT (l_extendedprice * (1 - l_discount) > 0))", "count(*)", L),
        row(L, 1, E.CUSTOM, None, "count_if(NOT (l_extendedprice < 50000)) = 0", "count_if(NOT (l_extendedprice < 50000))", "count(*)", L),
        row(L, 2, E.CUSTOM, None, "true", None, "count(*)", L),
    ),
    "exp_column_type": """
SELECT 'orders' AS suite, p AS position, k AS expectation, c AS column_name, s AS success,
  CAST(NULL AS DOUBLE) AS observed, CAST(NULL AS BIGINT) AS total
FROM (SELECT count_if(column_name = 'o_orderkey' AND data_type = 'BIGINT') AS big,
        count_if(column_name = 'o_orderkey' AND data_type = 'VARCHAR') AS txt,
        count_if(column_name = 'o_custkey') AS cust, count_if(column_name = 'gone') AS gone
      FROM duckdb_columns() WHERE table_name = 'orders'),
  LATERAL (VALUES (0, 'column_type', 'o_orderkey', big > 0), (1, 'column_type', 'o_orderkey', txt > 0),
    (2, 'column_exists', 'o_custkey', cust > 0), (3, 'column_exists', 'gone', gone > 0)) t(p, k, c, s)
UNION ALL
""" + row(O, 4, E.ROW_COUNT_BETWEEN, None, "count(*) >= 1", "count(*)", "count(*)", O),
    "exp_values_in_large_set": rows(
        row(O, 0, E.VALUES_IN_SET, "o_custkey", "count_if(o_custkey NOT BETWEEN 1 AND 1399) = 0", "count_if(o_custkey NOT BETWEEN 1 AND 1399)", "count(*)", O),
        row(O, 1, E.VALUES_IN_SET, "o_orderkey", "count_if(o_orderkey % 2 = 1 OR o_orderkey NOT BETWEEN 0 AND 39998) = 0",
            "count_if(o_orderkey % 2 = 1 OR o_orderkey NOT BETWEEN 0 AND 39998)", "count(*)", O),
        row(O, 2, E.VALUES_IN_SET, "o_orderpriority", "count_if(NOT regexp_full_match(o_orderpriority, '[0-9]-LOW')) = 0",
            "count_if(NOT regexp_full_match(o_orderpriority, '[0-9]-LOW'))", "count(*)", O),
    ),
    "exp_errors": """
SELECT 'orders' AS suite, p AS position, k AS expectation, c AS column_name, false AS success,
  CAST(NULL AS DOUBLE) AS observed, CAST(NULL AS BIGINT) AS total
FROM (VALUES (0, 'not_null', 'gone'), (1, 'between', 'o_orderstatus'), (2, 'custom', NULL),
  (3, 'match_regex', 'o_orderstatus'), (5, 'custom', NULL), (7, 'custom', NULL)) t(p, k, c)
UNION ALL
""" + rows(
        row(O, 4, E.NOT_NULL, "o_orderkey", "count_if(o_orderkey IS NULL) = 0", "count_if(o_orderkey IS NULL)", "count(*)", O),
        row(O, 6, E.CUSTOM, None, "count_if(NOT o_totalprice > 0) = 0", "count_if(NOT o_totalprice > 0)", "count(*)", O),
    ),
    "suite_summary": _SUMMARY_SQL,
    "exp_failing_rows": _FAILING_SQL,
}
