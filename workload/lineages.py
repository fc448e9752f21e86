"""Importers over text that Spark writes from the rows of the test tables.

The SQL twins do not parse anything: they list what the text was built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.plans.importers import airflow, dbt, expectation_suites, sql_lineage

from .common import r, spread, stamp, table

UNION = "\nUNION ALL\n"


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per order, in sixteen shapes."""
    k = F.col("o_orderkey")
    mart = F.concat(F.lit("mart.c_"), F.col("o_custkey").cast("string"))
    raw = F.concat(F.lit("raw.orders_"), F.lower("o_orderstatus"))
    users = F.concat(F.lit("raw.users_"), F.substring("o_orderpriority", 1, 1))
    shapes = (
        "CREATE TABLE %1$s AS\n  SELECT b.key, b.price, who.label AS buyer\nFROM %2$s b JOIN %3$s who ON b.buyer = who.key",
        "INSERT INTO %1$s (shelf, worth) SELECT shelf, stock.left * stock.cost worth FROM %2$s stock WHERE stock.left < %4$d",
        "create or replace view %1$s as select upper(g.town) town, datediff(g.until, h.since) as days_open, kind from %3$s h right join %2$s as g on h.no = g.no",
        "CREATE TEMP TABLE %1$s AS SELECT * FROM %2$s;",
        "SELECT z.key AS k FROM %1$s z JOIN %2$s ON 1 = 1",
        "WITH w AS (SELECT key FROM %2$s) INSERT INTO %1$s SELECT w.key FROM w",
        "INSERT OVERWRITE TABLE %1$s -- from nowhere\nSELECT l.m, r.n FROM %2$s l, %3$s r WHERE l.k = r.k AND l.t <> 'from dual'",
        "MERGE INTO %1$s t USING %2$s AS d ON t.k = d.k WHEN MATCHED THEN UPDATE SET t.v = d.v",
        "CREATE VIEW IF NOT EXISTS `%1$s` AS /* join hidden */ SELECT COUNT(*) AS rows_seen, MAX(h.at) newest FROM `%2$s` h",
        "insert into table %1$s select distinct case when u.ok then u.a else 0 end as picked, 1 as one from %2$s u",
        "CREATE TABLE %1$s USING parquet AS SELECT EXTRACT(year FROM at) AS y, a.i IS DISTINCT FROM a.j AS moved, a.k + 1 plus FROM %2$s a",
        "WITH c AS (SELECT k, v * 2 AS w FROM %2$s) INSERT INTO %1$s SELECT c.k, c.w + o.x AS sum FROM c JOIN %3$s o ON o.k = c.k",
        "INSERT INTO %1$s SELECT s.top, concat(s.name, ', from ', e.town) label FROM (SELECT max(v) AS top, n AS name FROM %2$s GROUP BY n) s, %3$s e",
        "SELECT `a b`.c FROM `my tab` `a b` WHERE EXISTS (SELECT 1 FROM %2$s z WHERE z.c = `a b`.c)",
        "CREATE VIEW %1$s AS SELECT t.u FROM %2$s t UNION ALL SELECT r.v FROM %3$s r",
        "INSERT INTO %1$s SELECT (SELECT max(q.m) FROM %3$s q) AS most, d FROM %2$s",
    )
    written = [F.format_string(s.replace("%4$d", "%4$s"), mart, raw, users, k) for s in shapes]
    text = F.when(k % 16 == 0, written[0])
    for shape, one in enumerate(written[1:], start=1):
        text = text.when(k % 16 == shape, one)
    return table(spark, sf_dir, "orders").select(k.alias("query_id"), text.alias("sql"))


_LOG = """log AS (SELECT o_orderkey AS query_id, o_orderkey % 16 AS shape, 'mart.c_' || o_custkey AS mart,
  'raw.orders_' || lower(o_orderstatus) AS raw, 'raw.users_' || substr(o_orderpriority, 1, 1) AS users FROM orders)"""

# Sources of a statement, in order.
_SOURCES = """CASE WHEN shape IN (0, 6, 11, 12, 14) THEN [raw, users] WHEN shape IN (2, 15) THEN [users, raw] WHEN shape = 4 THEN [mart, raw]
  WHEN shape = 13 THEN ['my tab', raw] ELSE [raw] END"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_lineage.statements(query_log(spark, sf_dir)).select(
        "query_id", "target_table", F.array_join("source_tables", ",").alias("source_tables")
    )


_TABLES_SQL = f"""
WITH {_LOG}
SELECT query_id, CASE WHEN shape NOT IN (4, 13) THEN mart END AS target_table,
  array_to_string({_SOURCES}, ',') AS source_tables FROM log"""


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_lineage.column_mappings(query_log(spark, sf_dir)).select(
        "query_id", "position", "target_column", "source_table", "source_column", "expression"
    )


_COLUMNS_SQL = f"""
WITH {_LOG}
SELECT query_id, CAST(p AS INTEGER) AS position, c AS target_column,
  CASE t WHEN 'raw' THEN raw WHEN 'users' THEN users WHEN 'mart' THEN mart WHEN 'my' THEN 'my tab' END AS source_table,
  s AS source_column, replace(e, '$', users) AS expression
FROM log JOIN (VALUES
  (0, 0, 'key', 'raw', 'key', 'b.key'), (0, 1, 'price', 'raw', 'price', 'b.price'), (0, 2, 'buyer', 'users', 'label', 'who.label AS buyer'),
  (1, 0, 'shelf', NULL, 'shelf', 'shelf'), (1, 1, 'worth', 'raw', 'left', 'stock.left * stock.cost worth'),
  (1, 1, 'worth', 'raw', 'cost', 'stock.left * stock.cost worth'),
  (2, 0, 'town', 'raw', 'town', 'upper(g.town) town'), (2, 1, 'days_open', 'raw', 'until', 'datediff(g.until, h.since) as days_open'),
  (2, 1, 'days_open', 'users', 'since', 'datediff(g.until, h.since) as days_open'), (2, 2, 'kind', NULL, 'kind', 'kind'),
  (4, 0, 'k', 'mart', 'key', 'z.key AS k'),
  (5, 0, 'key', 'raw', 'key', 'w.key'),
  (6, 0, 'm', 'raw', 'm', 'l.m'), (6, 1, 'n', 'users', 'n', 'r.n'),
  (8, 0, 'rows_seen', NULL, NULL, 'COUNT(*) AS rows_seen'), (8, 1, 'newest', 'raw', 'at', 'MAX(h.at) newest'),
  (9, 0, 'picked', 'raw', 'ok', 'case when u.ok then u.a else 0 end as picked'), (9, 0, 'picked', 'raw', 'a', 'case when u.ok then u.a else 0 end as picked'),
  (9, 1, 'one', NULL, NULL, '1 as one'),
  (10, 0, 'y', NULL, 'at', 'EXTRACT(year FROM at) AS y'), (10, 1, 'moved', 'raw', 'i', 'a.i IS DISTINCT FROM a.j AS moved'),
  (10, 1, 'moved', 'raw', 'j', 'a.i IS DISTINCT FROM a.j AS moved'), (10, 2, 'plus', 'raw', 'k', 'a.k + 1 plus'),
  (11, 0, 'k', 'raw', 'k', 'c.k'), (11, 1, 'sum', 'raw', 'v', 'c.w + o.x AS sum'), (11, 1, 'sum', 'users', 'x', 'c.w + o.x AS sum'),
  (12, 0, 'top', 'raw', 'v', 's.top'), (12, 1, 'label', 'raw', 'n', 'concat(s.name, '', from '', e.town) label'),
  (12, 1, 'label', 'users', 'town', 'concat(s.name, '', from '', e.town) label'),
  (13, 0, 'c', 'my', 'c', '`a b`.c'), (14, 0, 'u', 'raw', 'u', 't.u'), (14, 0, 'u', 'users', 'v', 'r.v'),
  (15, 0, 'most', 'users', 'm', '(SELECT max(q.m) FROM $ q) AS most'), (15, 1, 'd', NULL, 'd', 'd')) v(sh, p, c, t, s, e) ON sh = shape"""


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_lineage.table_lineage(query_log(spark, sf_dir)).select(
        "table", F.array_join("upstream_tables", ",").alias("upstream"), F.array_join("downstream_tables", ",").alias("downstream")
    )


_GRAPH_SQL = f"""
WITH {_LOG}, parsed AS (SELECT CASE WHEN shape NOT IN (4, 13) THEN mart END AS target, {_SOURCES} AS sources FROM log),
link AS (SELECT DISTINCT target, unnest(sources) AS source FROM parsed WHERE target IS NOT NULL),
seen AS (SELECT target AS t FROM parsed WHERE target IS NOT NULL UNION SELECT unnest(sources) FROM parsed)
SELECT t AS table,
  coalesce((SELECT string_agg(source, ',' ORDER BY source) FROM link WHERE target = t), '') AS upstream,
  coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM link WHERE source = t), '') AS downstream
FROM seen"""


def _column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_lineage.column_edges(query_log(spark, sf_dir))


_COLUMN_EDGES_SQL = f"""
SELECT DISTINCT mart AS target_table, target_column, source_table, source_column, expression AS transformation
FROM ({_COLUMNS_SQL}) c JOIN (SELECT o_orderkey, 'mart.c_' || o_custkey AS mart FROM orders) o ON o.o_orderkey = c.query_id
WHERE source_table IS NOT NULL AND o_orderkey % 16 NOT IN (4, 13)"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per part: three models, a test node, a source."""
    text = F.format_string(
        """{"metadata": {"dbt_version": "1.8"}, "nodes": {
 "model.p.base_%1$d": {"name": "base_%1$d", "resource_type": "model", "database": "db", "schema": "%2$s", "alias": "base",
   "columns": {"size": {"name": "size"}, "id": {"name": "id"}}, "tags": ["hourly"],
   "depends_on": {"nodes": ["source.p.raw_%1$d"], "macros": []}},
 "model.p.mid_%1$d": {"name": "mid_%1$d", "resource_type": "model", "schema": "%2$s", "columns": {},
   "depends_on": {"nodes": ["model.p.base_%1$d"]}},
 "model.p.top_%1$d": {"name": "top_%1$d", "resource_type": "model", "database": "db", "tags": ["b", "a"],
   "depends_on": {"nodes": ["model.p.mid_%1$d", "model.p.base_%1$d"]}},
 "test.p.check_%1$d": {"name": "check_%1$d", "resource_type": "test", "depends_on": {"nodes": ["model.p.top_%1$d"]}}},
"sources": {"source.p.raw_%1$d": {"name": "raw_%1$d", "source_name": "lake", "database": "raw", "schema": "public",
   "columns": {"id": {"name": "id"}}, "freshness": %3$s}},
"parent_map": {"model.p.base_%1$d": ["source.p.raw_%1$d"], "model.p.mid_%1$d": ["model.p.base_%1$d"],
   "model.p.top_%1$d": ["model.p.mid_%1$d", "model.p.base_%1$d"]},
"child_map": {"model.p.base_%1$d": ["model.p.mid_%1$d", "model.p.top_%1$d"], "model.p.mid_%1$d": ["model.p.top_%1$d"],
   "model.p.top_%1$d": ["test.p.check_%1$d"]}}""",
        F.col("p_partkey"),
        F.lower("p_type"),
        F.when(F.col("p_size") <= 20, F.format_string('{"warn_after": {"count": %d, "period": "hours"}}', "p_size"))
        .when(F.col("p_size") <= 40, F.lit('{"warn_after": {}}'))
        .otherwise(F.lit("null")),
    )
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("manifest_id"), text.alias("manifest"))


def _dbt_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = lambda c: F.array_join(c, ",").alias(c)
    return dbt.models(manifests(spark, sf_dir)).select(
        "manifest_id", "name", "database", "schema", "alias", join("columns"), join("upstream_models"),
        join("downstream_models"), join("tags"),
    )


_DBT_MODELS_SQL = UNION.join(
    f"""SELECT p_partkey AS manifest_id, '{n}_' || p_partkey AS name, '{db}' AS database, {schema} AS schema, '{alias}' AS alias,
  '{cols}' AS columns, {up} AS upstream_models, {down} AS downstream_models, '{tags}' AS tags FROM part"""
    for n, db, schema, alias, cols, up, down, tags in (
        ("base", "db", "lower(p_type)", "base", "id,size", "''", "'mid_' || p_partkey || ',top_' || p_partkey", "hourly"),
        ("mid", "", "lower(p_type)", "", "", "'base_' || p_partkey", "'top_' || p_partkey", ""),
        ("top", "db", "''", "", "", "'mid_' || p_partkey || ',base_' || p_partkey", "'check_' || p_partkey", "b,a"),
    )
)


def _dbt_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbt.sources(manifests(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


_DBT_SOURCES_SQL = """
SELECT p_partkey AS manifest_id, 'raw_' || p_partkey AS name, 'lake' AS source_name, 'raw' AS database, 'public' AS schema,
  'id' AS columns, CASE WHEN p_size <= 20 THEN p_size || ' hours' WHEN p_size <= 40 THEN '0 hours' END AS freshness_warn FROM part"""


def _dbt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbt.edges(manifests(spark, sf_dir))


_DBT_EDGES_SQL = UNION.join(
    f"SELECT p_partkey AS manifest_id, '{a}_' || p_partkey AS parent, '{b}_' || p_partkey AS child, 'dbt_model' AS kind FROM part"
    for a, b in (("source.p.raw", "base"), ("base", "mid"), ("mid", "top"), ("base", "top"))
)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pipeline event per event row; state, event name and date depend on the row."""
    v = F.col("event_id") % 7
    body = F.struct(
        F.concat(F.lit("load_"), "event_type", F.lit("_daily")).alias("dag_id"),
        F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("run_id"),
        F.when(v == 0, "queued").when(v == 1, "success").when(v == 2, "failed").when(v == 6, "odd").alias("state"),
        F.when(v == 1, "task_instance_failed").when(v == 3, "task_instance_success").when(v == 4, "started")
        .when(v == 5, "mystery").alias("event"),
        F.when(v != 2, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("execution_date"),
        F.col("value").alias("duration"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.to_json(body).alias("payload"))


def _airflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return airflow.events(payloads(spark, sf_dir)).select(
        "event_id", "event", "unknown_event", "dag_id", "run_id", stamp("execution_date").alias("execution_date"),
        r("duration_seconds").alias("duration_seconds"), "affected_table", "is_success", "is_failure", "is_terminal",
    )


_KIND = """CASE event_id % 7 WHEN 0 THEN 'DagRunQueued' WHEN 1 THEN 'DagRunSuccess' WHEN 2 THEN 'DagRunFailed'
  WHEN 3 THEN 'TaskInstanceSuccess' WHEN 4 THEN 'DagRunRunning' ELSE 'Unknown' END"""
_AIRFLOW_SQL = f"""
SELECT event_id, {_KIND} AS event, CASE event_id % 7 WHEN 5 THEN 'mystery' WHEN 6 THEN 'odd' END AS unknown_event,
  'load_' || event_type || '_daily' AS dag_id, 'run_' || event_id AS run_id,
  CASE WHEN event_id % 7 <> 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS execution_date,
  round(value, 6) AS duration_seconds, event_type || '.daily' AS affected_table,
  event_id % 7 IN (1, 3) AS is_success, event_id % 7 = 2 AS is_failure, event_id % 7 IN (1, 2, 3) AS is_terminal
FROM events"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = airflow.pipeline_status(airflow.events(payloads(spark, sf_dir)))
    return status.withColumn("last_success", stamp("last_success"))


_STATUS_SQL = f"""
SELECT 'load_' || event_type || '_daily' AS pipeline, event_type || '.daily' AS table_name,
  strftime(max(ts) FILTER (event_id % 7 IN (1, 3)), '%Y-%m-%d %H:%M:%S') AS last_success,
  max(k) FILTER (k IS NOT NULL) AS status
FROM (SELECT *, CASE WHEN event_id % 7 <> 2 AND date_trunc('second', ts) = max(date_trunc('second', ts)) FILTER (event_id % 7 <> 2) OVER (PARTITION BY event_type)
  THEN {_KIND} END AS k FROM events) GROUP BY event_type"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One suite document per customer, with bounds from the row."""
    text = F.format_string(
        """{"expectation_suite_name": "c%1$d", "expectations": [
 {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "email"}},
 {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": %1$d}},
 {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "id", "mostly": 0.95}},
 {"expectation_type": "expect_column_values_to_be_in_set", "kwargs": {"column": "seg", "value_set": ["%2$s", 7]}},
 {"expectation_type": "expect_column_values_to_not_be_in_set", "kwargs": {"column": "seg", "value_set": ["%2$s"]}},
 {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "bal", "min_value": -1.5, "max_value": %3$d}},
 {"expectation_type": "expect_column_quantile_values_to_be_between", "kwargs": {"column": "bal", "min_value": 0, "max_value": %3$d}},
 {"expectation_type": "expect_column_kl_divergence_to_be_less_than", "kwargs": {"column": "bal"}},
 {"expectation_type": "expect_column_values_to_match_regex", "kwargs": {"column": "name", "value": "^c"}},
 {"expectation_type": "expect_column_values_to_not_match_regex", "kwargs": {"column": "name", "regex": "x$"}},
 {"expectation_type": "expect_table_columns_to_match_set", "kwargs": {"column_list": ["a", "b"]}},
 {"expectation_type": "expect_column_values_to_be_of_type", "kwargs": {"column": "id", "type_": "bigint"}},
 {"expectation_type": "expect_something_else", "kwargs": {"column": "id"}}]}""",
        F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey").cast("bigint"),
    )
    return table(spark, sf_dir, "customer").select(text.alias("document"))


def _ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expectation_suites.translate(documents(spark, sf_dir)).select(
        "suite", "position", "expectation", F.col("column").alias("column_name"), "min_value", "max_value", "quantile",
        F.array_join("values", ",").alias("members"), "pattern", "expression", "dtype", r("tolerance").alias("tolerance"),
    )


_GE_SQL = """
SELECT 'c' || c_custkey AS suite, CAST(p AS INTEGER) AS position, k AS expectation, c AS column_name,
  CASE lo WHEN 'key' THEN c_custkey::DOUBLE ELSE TRY_CAST(lo AS DOUBLE) END AS min_value,
  CASE hi WHEN 'nation' THEN c_nationkey::DOUBLE ELSE TRY_CAST(hi AS DOUBLE) END AS max_value,
  q AS quantile, replace(m, '$', c_mktsegment) AS members, pat AS pattern, replace(ex, '$', c_mktsegment) AS expression,
  ty AS dtype, tol AS tolerance
FROM customer, (VALUES
  (0, 'column_exists', 'email', NULL, NULL, NULL::DOUBLE, NULL, NULL, NULL, NULL, 0.0::DOUBLE),
  (1, 'row_count_between', NULL, 'key', NULL, NULL, NULL, NULL, NULL, NULL, 0.0),
  (2, 'not_null', 'id', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.05),
  (3, 'column_values_to_be_in_set', 'seg', NULL, NULL, NULL, '$,7', NULL, NULL, NULL, 0.0),
  (4, 'custom', 'seg', NULL, NULL, NULL, NULL, NULL, 'CAST(`seg` AS STRING) NOT IN (''$'')', NULL, 0.0),
  (5, 'between', 'bal', '-1.5', 'nation', NULL, NULL, NULL, NULL, NULL, 0.0),
  (6, 'column_quantile_between', 'bal', '0', 'nation', 0.5, NULL, NULL, NULL, NULL, 0.0),
  (7, 'column_kl_divergence_less_than', 'bal', NULL, '0.1', NULL, NULL, NULL, NULL, NULL, 0.0),
  (8, 'match_regex', 'name', NULL, NULL, NULL, NULL, '^c', NULL, NULL, 0.0),
  (9, 'not_match_regex', 'name', NULL, NULL, NULL, NULL, 'x$', NULL, NULL, 0.0),
  (10, 'table_columns_match_ordered_list', NULL, NULL, NULL, NULL, 'a,b', NULL, NULL, NULL, 0.0),
  (11, 'column_type', 'id', NULL, NULL, NULL, NULL, NULL, NULL, 'bigint', 0.0)
) v(p, k, c, lo, hi, q, m, pat, ex, ty, tol)"""

QUERIES = {
    "lineage_tables": _tables,
    "lineage_columns": _columns,
    "lineage_column_edges": _column_edges,
    "lineage_graph": _graph,
    "dbt_models": _dbt_models,
    "dbt_sources": _dbt_sources,
    "dbt_edges": _dbt_edges,
    "airflow_events": _airflow,
    "pipeline_status": _status,
    "ge_translate": _ge,
}
ORACLE = {
    "lineage_tables": _TABLES_SQL,
    "lineage_columns": _COLUMNS_SQL,
    "lineage_column_edges": _COLUMN_EDGES_SQL,
    "lineage_graph": _GRAPH_SQL,
    "dbt_models": _DBT_MODELS_SQL,
    "dbt_sources": _DBT_SOURCES_SQL,
    "dbt_edges": _DBT_EDGES_SQL,
    "airflow_events": _AIRFLOW_SQL,
    "pipeline_status": _STATUS_SQL,
    "ge_translate": _GE_SQL,
}
