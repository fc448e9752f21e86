"""Root-cause hints for results of every monitor kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.operators.local_rows import union_all
from tablewatch.plans import monitors as M
from tablewatch.plans.root_cause import causal_stats, dimension_isolation, with_hints

from .common import AS_OF, AS_OF_SQL, r, stamp, table
from .monitor_checks import (
    UNION,
    VOLUME_BY_TYPE,
    _changed_orders,
    _volume_tables,
    event_history,
    event_volumes,
)
from .statistics import _HALF, _Y, ED, _cells_sql, _JS, _ks_sql


def _flat(df: DataFrame) -> DataFrame:
    return df.select("monitor_id", stamp("ts").alias("ts"), F.array_join("root_cause_hints", " | ").alias("hints"))


def _pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of the events table: the newest purchase and signup stand for pipeline runs."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("purchase", "signup"))
        .select(
            F.lit("events").alias("table_name"), F.concat(F.lit("load_"), "event_type").alias("pipeline"),
            F.date_trunc("second", "ts").cast("timestamp").alias("last_success"),
        )
    )


_PIPELINE = """(SELECT 'load_' || event_type AS pipe, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.000Z') AS last
  FROM events WHERE event_type IN ('purchase', 'signup') ORDER BY date_trunc('second', ts) DESC, 1 DESC LIMIT 1)"""


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(with_hints(event_volumes(spark, sf_dir), pipelines=_pipelines(spark, sf_dir)))


_VOLUME_SQL = f"""
SELECT 'vol:' || key AS monitor_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts,
  concat_ws(' | ', CASE
    WHEN c = 0 THEN 'Table ''events'' has 0 rows — possible upstream pipeline failure or source table empty'
    WHEN pct < -50 THEN printf('Volume dropped %.0f%% — check for upstream filter changes, partition pruning, or source disconnection', pct)
    WHEN pct > 100 THEN printf('Volume surged %.0f%% — possible data duplication, backfill, or upstream row explosion', pct) END,
    'Last successful run of upstream pipeline ''' || pipe || ''' was at ' || last) AS hints
FROM {VOLUME_BY_TYPE}, {_PIPELINE}"""


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = M.Freshness("fresh", "events", by=["event_type"], max_age_seconds=3600)
    results = M.check_freshness(table(spark, sf_dir, "events"), cfg, AS_OF)
    return _flat(with_hints(results, pipelines=_pipelines(spark, sf_dir)))


_FRESHNESS_SQL = f"""
SELECT 'fresh:' || event_type AS monitor_id, '{AS_OF}' AS ts, concat_ws(' | ',
  printf('Data in ''events'' is %.1fh old — expected max 3600s', age / 3600.0),
  'Pipeline ''' || pipe || ''' last ran at ' || last || ' — may be stalled or failed',
  'Check scheduler logs for pipeline ''' || pipe || ''' around ' || last,
  'Verify that upstream source is still producing data and the connection is active') AS hints
FROM (SELECT event_type, CAST((epoch_us({AS_OF_SQL}) - epoch_us(max(ts))) // 1000000 AS DOUBLE) AS age FROM events GROUP BY 1), {_PIPELINE}"""


def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    results = M.check_schema(
        M.Schema("schema", "orders"), M.schema_snapshot(_changed_orders(orders), "orders"),
        M.schema_snapshot(orders, "orders"), AS_OF,
    )
    n = orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    return _flat(with_hints(results)).withColumn("table_rows", n)


_SCHEMA_SQL = f"""
SELECT 'schema' AS monitor_id, '{AS_OF}' AS ts,
  'Column type changed: ~o_orderkey: bigint -> string — possible schema migration or data type update'
  || ' | New column detected: +o_channel (string) — possible schema migration or new data source version'
  || ' | Column removed: -o_custkey (bigint) — possible schema migration or column deprecation'
  || ' | Schema changes often correlate with application deployments or ETL code changes' AS hints,
  (SELECT count(*) FROM orders) AS table_rows"""


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events_drift")
    parts = [
        M.check_distribution(ev, M.Distribution(f"drift-{m}", "events", column="moved", metric=m, reference=_HALF,
                                                target=f"NOT ({_HALF})"), AS_OF)
        for m in ("ks", "js")
    ]
    return _flat(with_hints(union_all(parts)))


_DRIFT_SQL = UNION.join(
    f"""SELECT 'drift-{metric}' AS monitor_id, '{AS_OF}' AS ts, concat_ws(' | ',
  printf('Distribution drift detected via {metric} (score=%.4f, threshold=%.4f)', s, {limit}::DOUBLE),
  'Possible causes: upstream business logic changed, new data source, seasonality effect, or data corruption',
  'Compare the failing distribution against a known-good reference period to isolate which values changed most') AS hints
FROM ({source})"""
    for metric, limit, source in (
        ("ks", 0.3, f"SELECT score AS s FROM ({_ks_sql('x', ED, 'moved', _HALF, f'NOT ({_HALF})')})"),
        ("js", 0.1, f"SELECT sum({_JS}) / 2 AS s FROM ({_cells_sql('x', ED, 'moved', _HALF, f'NOT ({_HALF})')})"),
    )
)


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, uniqueness and referential results."""
    li = table(spark, sf_dir, "lineitem")
    parts = [
        M.check_correlation(li, M.Correlation("corr", "lineitem", column_x="l_quantity", column_y="l_extendedprice", min_abs=0.8), AS_OF),
        M.check_uniqueness(li, M.Uniqueness("uniq", "lineitem", columns=["l_orderkey", "l_linenumber"]), AS_OF),
        M.check_referential(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
            M.ReferentialIntegrity("ref", "documents", columns=["doc_id"]), AS_OF,
        ),
    ]
    return _flat(with_hints(union_all(parts)))


_KEYS_SQL = f"""
SELECT 'corr' AS monitor_id, '{AS_OF}' AS ts,
  printf('Correlation between ''l_quantity'' and ''l_extendedprice'' changed to %.4f (threshold: 0.8000)', corr(l_quantity, l_extendedprice))
  || ' | Possible causes: business logic change affecting one column, data quality issue in join key, or shifted data distribution' AS hints
FROM lineitem
UNION ALL
SELECT 'uniq', '{AS_OF}',
  printf('Duplicate ratio %.2f%% exceeds threshold — check for upstream dedup logic failures or repeated data loads', (sum(n) - count(*)) * 100.0::DOUBLE / sum(n))
  || ' | Common causes: missing DISTINCT in pipeline, repeated ingestion, or join explosion'
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL
SELECT 'ref', '{AS_OF}',
  printf('Referential integrity violation: %.0f orphan rows (%.1f%%)', count_if(l.doc_id IS NULL)::DOUBLE, count_if(l.doc_id IS NULL) * 100.0::DOUBLE / count(*))
  || ' | Possible causes: source table deleted rows without cascade, ETL order-of-operations changed, or data cleanup scripts running'
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom SQL, model drift and cost results."""
    li = table(spark, sf_dir, "lineitem")
    usage = li.select(F.col("l_returnflag").alias("flag"), F.round("l_extendedprice", 0).alias("cost"))
    parts = [
        M.check_custom_sql({"orders": table(spark, sf_dir, "orders")},
                           M.CustomSql("sql", "orders", query="SELECT avg(o_totalprice) FROM orders", expected=1000.0), AS_OF),
        M.check_ml_drift(li, M.MlDrift("ml", "lineitem", model="pricing", columns=["l_quantity"], baseline=_Y + "1996",
                                       current=_Y + "1997"), AS_OF),
        M.check_cost(usage, M.Cost("cost", "lineitem", resource="compute_cost", resource_column="flag", budget=1e6), AS_OF),
    ]
    return _flat(with_hints(union_all(parts)))


_VALUES_SQL = f"""
SELECT 'sql' AS monitor_id, '{AS_OF}' AS ts,
  printf('Custom SQL check returned %.4f — review query logic for upstream changes', avg(o_totalprice))
  || ' | Check if source schema changed, data volume shifted, or business rules were updated' AS hints FROM orders
UNION ALL
SELECT 'ml', '{AS_OF}',
  printf('ML drift detected for model ''pricing'' on metric ''prediction_drift'' (score=%.4f)', sum({_JS}) / 2)
  || ' | Check for training-serving skew, data distribution shift in upstream features, or model staleness'
  || ' | Consider retraining the model or reviewing feature engineering pipeline for changes'
FROM ({_cells_sql("x", "lineitem", "l_quantity", _Y + "1996", _Y + "1997")})
UNION ALL
SELECT 'cost:' || l_returnflag, '{AS_OF}',
  printf('Cost anomaly for resource ''compute_cost'': actual=%.2f, budget=%.2f', sum(round(l_extendedprice, 0)), 1000000.0::DOUBLE)
  || ' | Possible causes: query pattern changed, data volume increased, inefficient joins, or pricing model changes'
  || ' | Review recent query performance metrics and consider adding resource limits or query optimization'
FROM lineitem GROUP BY l_returnflag"""


def _causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return causal_stats(event_history(spark, sf_dir), 30).select(
        "monitor_id", "history_rows", r("granger_f").alias("granger_f"), r("pca_share").alias("pca_share")
    )


_CAUSAL_ROWS = f"""
SELECT monitor_id, n AS history_rows,
  CASE WHEN n >= 5 AND u > 0 AND (r - u) / 2 / (u / (n - 2)) > 0 THEN (r - u) / 2 / (u / (n - 2)) END AS granger_f,
  CASE WHEN n >= 3 AND sigma > 0 THEN least(1.0, abs(last - mean) / sigma) END AS pca_share
FROM (
  SELECT monitor_id, count(*) AS n, sum((c - p1) * (c - p1)) FILTER (p2 IS NOT NULL) AS r, sum((c - p2) * (c - p2)) AS u,
    arg_max(c, b) AS last, avg(c) AS mean, stddev_pop(c) AS sigma
  FROM (SELECT *, lag(c) OVER w AS p1, lag(c, 2) OVER w AS p2 FROM (
      SELECT 'vol:' || key AS monitor_id, b, c, row_number() OVER (PARTITION BY key ORDER BY b DESC) AS rn FROM {VOLUME_BY_TYPE})
    WHERE rn <= 30 WINDOW w AS (PARTITION BY monitor_id ORDER BY b))
  GROUP BY 1)"""
_CAUSAL_SQL = f"""
SELECT monitor_id, history_rows, round(granger_f, 6) AS granger_f, round(pca_share, 6) AS pca_share
FROM ({_CAUSAL_ROWS})"""


def _dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    found = dimension_isolation(
        table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], year == 1999, year == 2001,
        F.round("o_totalprice", 0),
    )
    return found.select(
        "dimension", "segment", "before", "after", "change", r("share").alias("share")
    )


_DIMENSION_SQL = """
SELECT dimension, segment, b AS before, a AS after, a - b AS change, round(abs(a - b) / total, 6) AS share FROM (
  SELECT *, sum(abs(a - b)) OVER (PARTITION BY dimension) AS total,
    row_number() OVER (PARTITION BY dimension ORDER BY abs(a - b) DESC, segment DESC) AS rn
  FROM (SELECT dimension, segment, sum(CASE WHEN y = 1999 THEN v ELSE 0 END) AS b, sum(CASE WHEN y = 2001 THEN v ELSE 0 END) AS a FROM (
      SELECT 'o_orderstatus' AS dimension, o_orderstatus AS segment, year(o_orderdate) AS y, round(o_totalprice, 0) AS v FROM orders
      UNION ALL
      SELECT 'o_orderpriority', o_orderpriority, year(o_orderdate), round(o_totalprice, 0) FROM orders)
    WHERE y IN (1999, 2001) GROUP BY 1, 2)) WHERE rn = 1"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume hints with history, the segment that moved, and deployments shortly before."""
    ev = _volume_tables(spark, sf_dir)
    day = F.to_date("ts")
    moved = dimension_isolation(
        ev, ["event_type"], day == F.lit("2024-01-24").cast("date"), day == F.lit("2024-01-25").cast("date")
    )
    results = event_volumes(spark, sf_dir)
    segments = results.select("monitor_id").distinct().join(
        F.broadcast(moved.select("segment")), F.col("monitor_id").endswith(F.col("segment"))
    )
    deployments = table(spark, sf_dir, "events").where("event_type = 'signup' AND value > 60").select(
        F.concat(F.lit("release-"), "user_id").alias("name"), F.date_trunc("second", "ts").alias("deployed_at")
    )
    return _flat(
        with_hints(
            results, history=event_history(spark, sf_dir), dimensions=segments, deployments=deployments,
            deployment_window_seconds=6 * 3600, history_rows=30,
        )
    )


_CONTEXT_SQL = f"""
WITH causal AS ({_CAUSAL_ROWS}),
moved AS (SELECT segment FROM (
  SELECT event_type AS segment, count_if(CAST(ts AS DATE) = DATE '2024-01-25') * 4 - count_if(CAST(ts AS DATE) = DATE '2024-01-24') AS change
  FROM events GROUP BY 1) ORDER BY abs(change) DESC, segment DESC LIMIT 1),
ship AS (SELECT date_trunc('second', ts) AS at_time, 'release-' || user_id AS name FROM events WHERE event_type = 'signup' AND value > 60),
base AS (SELECT *, (SELECT arg_max(strftime(s.at_time, '%Y-%m-%dT%H:%M:%S.000Z') || '#' || s.name, struct_pack(t := s.at_time, n := s.name))
    FROM ship s WHERE s.at_time <= b AND s.at_time >= b - INTERVAL 6 HOUR) AS shipped
  FROM {VOLUME_BY_TYPE})
SELECT monitor_id, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, concat_ws(' | ', CASE
    WHEN c = 0 THEN 'Table ''events'' has 0 rows — possible upstream pipeline failure or source table empty'
    WHEN pct < -50 THEN printf('Volume dropped %.0f%% — check for upstream filter changes, partition pruning, or source disconnection', pct)
    WHEN pct > 100 THEN printf('Volume surged %.0f%% — possible data duplication, backfill, or upstream row explosion', pct) END,
  CASE WHEN granger_f IS NOT NULL THEN printf('[Granger causality] Past values predict current anomaly (F=%.4f)', granger_f) END,
  CASE WHEN pca_share IS NOT NULL THEN printf('[PCA] Top dimension contributed %.1f%% to anomaly score', pca_share * 100) END,
  CASE WHEN key = segment THEN '[Dimension isolation] Segment ''' || segment || ''' drove the change' END,
  CASE WHEN shipped IS NOT NULL THEN '[Deployment correlation] ''' || split_part(shipped, '#', 2) || ''' deployed at '
    || split_part(shipped, '#', 1) || ' — within anomaly window' END) AS hints
FROM base JOIN causal ON monitor_id = 'vol:' || key, moved"""

QUERIES = {
    "hints_volume": _volume,
    "hints_freshness": _freshness,
    "hints_schema": _schema,
    "hints_distribution": _drift,
    "hints_keys": _keys,
    "hints_values": _values,
    "hints_context": _context,
    "causal_stats": _causal,
    "dimension_isolation": _dimension,
}
ORACLE = {
    "hints_volume": _VOLUME_SQL,
    "hints_freshness": _FRESHNESS_SQL,
    "hints_schema": _SCHEMA_SQL,
    "hints_distribution": _DRIFT_SQL,
    "hints_keys": _KEYS_SQL,
    "hints_values": _VALUES_SQL,
    "hints_context": _CONTEXT_SQL,
    "causal_stats": _CAUSAL_SQL,
    "dimension_isolation": _DIMENSION_SQL,
}
