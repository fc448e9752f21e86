"""Streams over the event file, drained to a table and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch import streaming
from tablewatch.plans import expectations as E
from tablewatch.plans.monitors import ThresholdConfig
from tablewatch.session import shared_dir

from .common import r, stamp, table
from .incident_flows import _CHAIN, WINDOW


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    streaming.use_rocksdb(spark)
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and newest row per type; windows the watermark has closed."""
    metrics = streaming.windowed_metrics(event_stream(spark, sf_dir), by=["event_type"], watermark="10 minutes")
    return streaming.drain(metrics, "stream-volume").select(
        stamp("window_start").alias("window_start"), "event_type", "row_count", stamp("newest").alias("newest")
    )


_VOLUME_SQL = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS row_count,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest
FROM events GROUP BY date_trunc('hour', ts), event_type
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR
  <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"""


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = streaming.windowed_metrics(event_stream(spark, sf_dir), window="2 days", slide="1 day", watermark="1 hour")
    return streaming.drain(metrics, "stream-sliding").select(
        stamp("window_start").alias("window_start"), "row_count", stamp("newest").alias("newest")
    )


_SLIDING_SQL = """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS row_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest
FROM (SELECT ts, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events)
GROUP BY w HAVING w + INTERVAL 2 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"""


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark, "stream-dedup")
    streaming.deduplicate_batches(
        event_stream(spark, sf_dir), "event_type", "ts", "event_id", base, f"{base}/checkpoint", WINDOW, available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{base}/rows").select("event_id", "event_type", "duplicate")


_DEDUP_SQL = f"""
WITH RECURSIVE ev AS (SELECT event_id, event_type AS group_key, ts FROM events), {_CHAIN}
SELECT event_id, group_key AS event_type,
  NOT EXISTS (SELECT 1 FROM chain c WHERE c.group_key = ev.group_key AND c.ts = ev.ts) AS duplicate FROM ev"""


def _threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streaming.threshold_stream(event_stream(spark, sf_dir), "event_type", "ts", "value")
    return streaming.drain(rows, "stream-threshold").select(
        "monitor_id", F.col("at_micros"), "score", r("threshold").alias("threshold")
    )


_THRESHOLD_SQL = """
SELECT event_type AS monitor_id, epoch_us(ts) AS at_micros, value AS score,
  round(CASE WHEN len(h) > 3 THEN greatest(list_median(h) + 3.0 * 1.4826 * list_median(list_transform(h, lambda x: abs(x - list_median(h)))), 0.001) END, 6) AS threshold
FROM (SELECT *, list(value) OVER (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS h FROM events)"""

SUITE = [
    E.not_null("user_id"), E.between("value", 0, 1000), E.values_in_set("event_type", ["click", "view"]),
    E.unique("event_id"),
]


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = shared_dir(spark, "stream-suite")
    query = streaming.suite_per_batch(
        event_stream(spark, sf_dir), E.ExpectationSuite("events", SUITE), f"{base}/out", f"{base}/checkpoint", True
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "position", "expectation", "success",
        r("observed").alias("observed"), "total",
    )


_SUITE_SQL = """
SELECT CAST(0 AS BIGINT) AS batch_id, 0 AS position, 'not_null' AS expectation, count_if(user_id IS NULL) = 0 AS success,
  CAST(count_if(user_id IS NULL) AS DOUBLE) AS observed, count(*) AS total FROM events
UNION ALL
SELECT 0, 1, 'between', count_if(value < 0 OR value > 1000) = 0, CAST(count_if(value < 0 OR value > 1000) AS DOUBLE), count(value) FROM events
UNION ALL
SELECT 0, 2, 'column_values_to_be_in_set', count_if(event_type NOT IN ('click', 'view')) = 0,
  CAST(count_if(event_type NOT IN ('click', 'view')) AS DOUBLE), count(*) FROM events
UNION ALL
SELECT 0, 3, 'unique', count(DISTINCT event_id) = count(*), CAST(count(*) - count(DISTINCT event_id) AS DOUBLE), count(*) FROM events"""

LIMITS = {"mad": 3.0, "sigma": 2.0, "iqr": 1.5}
MOST = 90.0  # of a learned limit


def _threshold_by(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = shared_dir(spark, f"stream-{method}")
        streaming.threshold_batches(
            event_stream(spark, sf_dir), base, f"{base}/checkpoint", "event_type", "ts", "value",
            ThresholdConfig(method=method, sensitivity=LIMITS[method], max_threshold=MOST), available_now=True,
        ).awaitTermination()
        return spark.read.parquet(f"{base}/rows").select("monitor_id", "at_micros", "score", r("threshold").alias("threshold"))

    return query


def _threshold_by_sql(limit: str) -> str:
    return f"""
SELECT event_type AS monitor_id, epoch_us(ts) AS at_micros, value AS score,
  round(CASE WHEN len(h) > 3 THEN least(greatest({limit}, 0.001), {MOST}) END, 6) AS threshold
FROM (SELECT *, list_sort(h0) AS h FROM (
  SELECT *, list(value) OVER (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS h0 FROM events))"""


_AT = lambda p: f"h[CAST(floor(len(h) * {p}) AS INTEGER) + 1]"
_LIMIT_SQL = {
    "mad": "list_median(h) + 3.0 * 1.4826 * list_median(list_transform(h, lambda x: abs(x - list_median(h))))",
    "sigma": "list_avg(h) + 2.0 * list_stddev_pop(h)",
    "iqr": f"{_AT(0.75)} + 1.5 * ({_AT(0.75)} - {_AT(0.25)})",
}

QUERIES = {
    "stream_volume": _volume,
    "stream_sliding": _sliding,
    "stream_dedup": _dedup,
    "stream_auto_threshold": _threshold,
    **{f"stream_auto_threshold_{m}": _threshold_by(m) for m in LIMITS},
    "stream_suite": _suite,
}
ORACLE = {
    "stream_volume": _VOLUME_SQL,
    "stream_sliding": _SLIDING_SQL,
    "stream_dedup": _DEDUP_SQL,
    "stream_auto_threshold": _THRESHOLD_SQL,
    **{f"stream_auto_threshold_{m}": _threshold_by_sql(limit) for m, limit in _LIMIT_SQL.items()},
    "stream_suite": _SUITE_SQL,
}
