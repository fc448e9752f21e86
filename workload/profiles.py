"""Profiles, value shapes, suggestions and the table inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.operators.distinct import top_k
from tablewatch.operators.local_rows import constant_rows, union_all
from tablewatch.plans.profile import profile, profile_shapes
from tablewatch.plans.suggest import suggest, to_suite
from tablewatch.plans.suite import run_suite, summarize
from tablewatch.session import shared_dir
from tablewatch.sources.files import inline, open_table
from tablewatch.sources.inventory import execute_query, table_inventory

from .common import AS_OF, INJECTED, TABLES, injected_sql, r, table
from .statistics import _histogram_sql

UNION = "\nUNION ALL\n"

# Columns of the profiled tables: (name, Spark type, numeric).
PROFILED = {
    "orders_gaps": (
        ("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_orderstatus", "string", False),
        ("o_totalprice", "double", True), ("o_orderdate", "timestamp_ntz", False), ("o_orderpriority", "string", False),
        ("price_gap", "double", True), ("key_gap", "bigint", True),
    ),
    "part": (
        ("p_partkey", "bigint", True), ("p_name", "string", False), ("p_brand", "string", False),
        ("p_type", "string", False), ("p_size", "int", True), ("p_retailprice", "double", True),
    ),
    "lineitem": (
        ("l_orderkey", "bigint", True), ("l_partkey", "bigint", True), ("l_suppkey", "bigint", True),
        ("l_linenumber", "int", True), ("l_quantity", "double", True), ("l_extendedprice", "double", True),
        ("l_discount", "double", True), ("l_tax", "double", True), ("l_returnflag", "string", False),
        ("l_linestatus", "string", False), ("l_shipdate", "timestamp_ntz", False),
    ),
}


def _profile_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return profile(table(spark, sf_dir, name), name, AS_OF, [c for c, _, _ in PROFILED[name]])


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = union_all([_profile_of(spark, sf_dir, name) for name in PROFILED])
    return parts.select(
        "table_name", "column_name", "dtype", "row_count", "null_count", "distinct_count",
        r("min_val", 4).alias("min_val"), r("max_val", 4).alias("max_val"), r("mean_val", 3).alias("mean_val"),
        r("stddev_val", 3).alias("stddev_val"),
        *[r(F.get("quantiles", F.lit(i)), 4).alias(f"q{i}") for i in range(5)],
    )


def _relation(name: str) -> str:
    return injected_sql(name) if name in INJECTED else name


def _profile_rows(name: str) -> str:
    parts = []
    for column, dtype, numeric in PROFILED[name]:
        rel = _relation(name)
        stats = (
            f"min({column})::DOUBLE AS min_val, max({column})::DOUBLE AS max_val, avg({column}) AS mean_val, "
            f"stddev_samp({column}) AS stddev_val"
            if numeric
            else "NULL::DOUBLE AS min_val, NULL::DOUBLE AS max_val, NULL::DOUBLE AS mean_val, NULL::DOUBLE AS stddev_val"
        )
        ranks = ", ".join(
            f"max(x) FILTER (i = CAST(floor((n - 1) * {q} + 0.5) AS BIGINT))::DOUBLE AS q{j}"
            if numeric
            else f"max(NULL::DOUBLE) AS q{j}"
            for j, q in enumerate((0.0, 0.25, 0.5, 0.75, 1.0))
        )
        parts.append(
            f"""
SELECT '{name}' AS table_name, '{column}' AS column_name, '{dtype}' AS dtype, a.*, b.* FROM (
  SELECT count(*) AS row_count, count_if({column} IS NULL) AS null_count,
    count(DISTINCT {column}) + max(CAST({column} IS NULL AS INT)) AS distinct_count, {stats} FROM {rel}) a,
  (SELECT {ranks} FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS i, count(*) OVER () AS n
     FROM {rel} WHERE {column} IS NOT NULL)) b"""
        )
    return UNION.join(parts)


_PROFILE_ALL = UNION.join(_profile_rows(n) for n in PROFILED)
_PROFILE_SQL = f"""
SELECT table_name, column_name, dtype, row_count, null_count, distinct_count, round(min_val, 4) AS min_val,
  round(max_val, 4) AS max_val, round(mean_val, 3) AS mean_val, round(stddev_val, 3) AS stddev_val,
  round(q0, 4) AS q0, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3, round(q4, 4) AS q4
FROM ({_PROFILE_ALL})"""


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored histogram text of two columns, unrolled."""
    shapes = profile_shapes(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], 10, 3)
    bars = F.posexplode(F.from_json("histogram_json", "array<double>")).alias("bin", "share")
    return shapes.select("column_name", bars).select("column_name", "bin", r("share", 9).alias("share"))


_HISTOGRAM_SQL = UNION.join(
    f"SELECT name AS column_name, bin, share FROM ({_histogram_sql(c, 'customer', c, 10)})"
    for c in ("c_acctbal", "c_nationkey")
)


def _top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        ("documents", "source", 7), ("documents", "text", 5), ("events", "user_id", 10), ("pages", "url", 4),
    ]
    return union_all(
        [
            top_k(table(spark, sf_dir, t).select(F.col(c).cast("string").alias("value")), "value", k).select(
                F.lit(f"{t}.{c}").alias("column_name"), F.sha2("value", 256).alias("value"), "count"
            )
            for t, c, k in parts
        ]
    )


_TOP_K_SQL = UNION.join(
    f"""SELECT * FROM (SELECT '{t}.{c}' AS column_name, sha256(value) AS value, count FROM (
  SELECT CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {t} GROUP BY 1) ORDER BY count DESC, value_raw LIMIT {k})""".replace(
        "sha256(value) AS value, count FROM", "sha256(value) AS value, value AS value_raw, count FROM"
    ).replace("SELECT * FROM (SELECT", "SELECT column_name, value, count FROM (SELECT", 1)
    for t, c, k in (
        ("documents", "source", 7), ("documents", "text", 5), ("events", "user_id", 10), ("pages", "url", 4),
    )
)


def _suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        suggest(_profile_of(spark, sf_dir, name), table(spark, sf_dir, name).select(*[c for c, _, _ in cols]))
        for name, cols in PROFILED.items()
    ]
    return union_all(parts).select(
        "table_name", "column_name", "expectation", r("min_value", 3).alias("min_value"),
        r("max_value", 3).alias("max_value"), F.array_join("values", ",").alias("members"),
        r("confidence").alias("confidence"), "reason",
    )


_MEMBERS = UNION.join(
    f"SELECT '{name}' AS table_name, '{column}' AS column_name, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS members "
    f"FROM (SELECT DISTINCT {column} AS v FROM {_relation(name)})"
    for name, columns in PROFILED.items()
    for column, _, numeric in columns
    if numeric
)
_SUGGEST_SQL = f"""
WITH p AS ({_PROFILE_ALL}), s AS (
  SELECT *, null_count / CAST(greatest(row_count, 1) AS DOUBLE) AS np, q3 - q1 AS iqr FROM p)
SELECT table_name, column_name, 'not_null' AS expectation, NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value,
  NULL::VARCHAR AS members, round(0.9 - least(np * 5, 0.8), 6) AS confidence,
  printf('%.1f%% null values — consider not_null expectation', np * 100) AS reason
FROM s WHERE null_count > 0 AND np < 0.05
UNION ALL
SELECT table_name, column_name, 'unique', NULL, NULL, NULL, 0.8,
  'All ' || row_count || ' values are unique — consider unique expectation' FROM s WHERE distinct_count = row_count AND row_count > 1
UNION ALL
SELECT table_name, column_name, 'between', round(min_val, 3), round(max_val, 3), NULL, 0.6,
  printf('Values range [%.2f, %.2f] — consider between expectation', min_val, max_val) FROM s WHERE max_val > min_val
UNION ALL
SELECT table_name, column_name, 'between', round(q1 - 1.5 * iqr, 3), round(q3 + 1.5 * iqr, 3), NULL, 0.5,
  printf('IQR-based bounds [%.2f, %.2f] — consider between expectation', q1 - 1.5 * iqr, q3 + 1.5 * iqr) FROM s WHERE iqr > 0
UNION ALL
SELECT table_name, column_name, 'column_mean_between', round(least(mean_val * 0.8, mean_val * 1.2), 3),
  round(greatest(mean_val * 0.8, mean_val * 1.2), 3), NULL, 0.4,
  printf('Mean is %.2f — consider column_mean_between(mean*0.8, mean*1.2)', mean_val) FROM s WHERE mean_val IS NOT NULL
UNION ALL
SELECT table_name, column_name, 'column_values_to_be_in_set', NULL, NULL, m.members, 0.3,
  'Only ' || distinct_count || ' distinct values — consider values_in_set expectation'
FROM s JOIN ({_MEMBERS}) m USING (table_name, column_name)
WHERE null_count = 0 AND distinct_count BETWEEN 1 AND 20 AND min_val IS NOT NULL"""


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of a table, run on that table."""
    df = table(spark, sf_dir, "part")
    suite = to_suite("suggested", suggest(_profile_of(spark, sf_dir, "part"), df))
    return summarize(run_suite(suite, df)).withColumn("success_percent", r("success_percent"))


# Every suggestion holds on its own table but the fences, which outliers break.
_BROKEN_FENCES = " + ".join(
    f"(SELECT CAST(count(*) > 0 AS BIGINT) FROM part, p WHERE p.column_name = '{c}' AND q3 > q1 "
    f"AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))"
    for c, _, numeric in PROFILED["part"]
    if numeric
)
_ROUND_TRIP_SQL = f"""
WITH p AS ({_profile_rows("part")}), n AS (
  SELECT count_if(null_count > 0 AND null_count < 0.05 * row_count) + count_if(distinct_count = row_count AND row_count > 1)
    + count_if(max_val > min_val) + count_if(q3 > q1) + count_if(mean_val IS NOT NULL)
    + count_if(null_count = 0 AND distinct_count BETWEEN 1 AND 20 AND min_val IS NOT NULL) AS total FROM p),
f AS (SELECT {_BROKEN_FENCES} AS failed)
SELECT 'suggested' AS suite, CAST(total AS BIGINT) AS total, CAST(total - failed AS BIGINT) AS passed, CAST(failed AS BIGINT) AS failed,
  round(100.0 * (total - failed) / total, 6) AS success_percent, failed = 0 AS success FROM n, f"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_inventory(spark, {n: table(spark, sf_dir, n) for n in TABLES})


_INVENTORY_SQL = """
SELECT c.table_name, c.column_index - 1 AS ordinal, c.column_name,
  CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
    WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
    ELSE c.data_type END AS dtype, true AS nullable, n.row_count
FROM duckdb_columns() c JOIN (""" + UNION.join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES
) + ") n ON n.table_name = c.table_name"

def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and read back with their types found."""
    path = shared_dir(spark, "csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    back = open_table(spark, "csv", path)
    return back.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("c_nationkey").cast("bigint").alias("nations"), r(F.sum("c_acctbal"), 2).alias("balance"),
        F.countDistinct("c_name").alias("names"),
    )


_CSV_SQL = """
SELECT c_mktsegment, count(*) AS customers, CAST(sum(c_nationkey) AS BIGINT) AS nations, round(sum(c_acctbal), 2) AS balance,
  count(DISTINCT c_name) AS names FROM customer GROUP BY 1"""


def _in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A local table of nations beside the customers."""
    rows = [tuple(x) for x in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()]
    nations = inline(spark, rows, "n_nationkey BIGINT, n_name STRING")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(
        F.count(F.lit(1)).alias("customers")
    )


_IN_MEMORY_SQL = "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


def _execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of two queries as the runner reports them."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("executed_orders")
    try:
        runs = [
            (name, execute_query(spark, f"SELECT * FROM executed_orders WHERE {condition}").row_count)
            for name, condition in (("all", "true"), ("large", "o_totalprice > 200000"))
        ]
    finally:
        spark.catalog.dropTempView("executed_orders")
    return constant_rows(spark, "query STRING, row_count BIGINT", runs)


_EXECUTION_SQL = """
SELECT 'all' AS query, count(*) AS row_count FROM orders UNION ALL SELECT 'large', count_if(o_totalprice > 200000) FROM orders"""


QUERIES = {
    "source_csv": _csv,
    "source_in_memory": _in_memory,
    "query_execution": _execution,
    "profile_table": _profile,
    "profile_histogram": _histogram,
    "profile_top_k": _top_k,
    "suggest_expectations": _suggest,
    "suggest_round_trip": _round_trip,
    "table_inventory": _inventory,
}
ORACLE = {
    "source_csv": _CSV_SQL,
    "source_in_memory": _IN_MEMORY_SQL,
    "query_execution": _EXECUTION_SQL,
    "profile_table": _PROFILE_SQL,
    "profile_histogram": _HISTOGRAM_SQL,
    "profile_top_k": _TOP_K_SQL,
    "suggest_expectations": _SUGGEST_SQL,
    "suggest_round_trip": _ROUND_TRIP_SQL,
    "table_inventory": _INVENTORY_SQL,
}
