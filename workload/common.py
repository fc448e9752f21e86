"""Loading of tables and the projections that make results comparable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.session import configure

# Fixed moment the checks look back from (after the last event).
AS_OF = "2024-02-05 00:00:00"

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Changed copies of clean tables, written once for both engines.
INJECTED = {
    "orders_gaps": (
        "orders",
        "*, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS price_gap, "
        "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS key_gap",
    ),
    "lineitem_bad": (
        "lineitem",
        "*, CASE WHEN l_partkey % 97 = 0 THEN -1.0 ELSE l_quantity END AS qty_bad, "
        "CASE WHEN l_partkey % 200 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS part_bad, "
        "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS price_gap",
    ),
    "customer_bad": (
        "customer",
        "*, CASE WHEN c_custkey % 40 = 0 THEN 'bad' ELSE c_name END AS name_bad",
    ),
    "events_nan": (
        "events",
        "*, CASE WHEN event_id % 500 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value_nan, "
        "CAST(1.0 AS DOUBLE) AS one",
    ),
    "events_drift": (
        "events",
        "*, CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN value * 1.5 + 10 ELSE value END AS moved",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    if name in INJECTED:
        source, columns = INJECTED[name]
        return table(spark, sf_dir, source).selectExpr(*_split_top(columns))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key: a file of few row groups is read by as few tasks, which would then do all that follows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _split_top(columns: str) -> list[str]:
    """Select items of a flat list (commas inside parentheses stay)."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


def injected_sql(name: str) -> str:
    source, columns = INJECTED[name]
    return f"(SELECT {columns} FROM {source})"


def r(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def stamp(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def flat_monitor(results: DataFrame, digits: int = 6) -> DataFrame:
    """Monitor results without the detail map."""
    return results.select(
        "monitor_id", "monitor_type", "table_name", "alert", "severity",
        r("score", digits).alias("score"), r("threshold", digits).alias("threshold"), "message",
        stamp("ts").alias("ts"),
    )


def monitor_sql(
    rows: str, *, monitor_id: str, kind: str, table_name: str, alert: str, critical: str,
    score: str, threshold: str, message: str, ts: str, digits: int = 6, prefix: str = "",
) -> str:
    """SQL of ``flat_monitor`` rows from a relation with the metric columns."""
    return f"""
{prefix}
SELECT {monitor_id} AS monitor_id, '{kind}' AS monitor_type, '{table_name}' AS table_name,
  {alert} AS alert,
  CASE WHEN NOT ({alert}) THEN 'INFO' WHEN {critical} THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  round(CAST({score} AS DOUBLE), {digits}) AS score,
  round(CAST({threshold} AS DOUBLE), {digits}) AS threshold,
  {message} AS message, strftime({ts}, '%Y-%m-%d %H:%M:%S') AS ts
FROM {rows}
"""


AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
