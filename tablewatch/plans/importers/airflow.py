"""Pipeline run events: classification, affected tables, last success."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The event fields that are read.
PAYLOAD = (
    "dag_id STRING, run_id STRING, state STRING, execution_date STRING, start_date STRING, "
    "end_date STRING, task_id STRING, duration DOUBLE, operator STRING, dag_run_url STRING, event STRING"
)
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
LOAD_PREFIX = "^(load|ingest|etl|sync|refresh|transform)_"

# Event kind by state or event name, first match wins.
KINDS = (
    ("DagRunQueued", ("queued",), ("dag_run_queued",)),
    ("DagRunRunning", ("running",), ("dag_run_running", "running", "started")),
    ("DagRunSuccess", ("success",), ("dag_run_success", "success")),
    ("DagRunFailed", ("failed",), ("dag_run_failed", "failed")),
    ("TaskInstanceRunning", (), ("task_instance_running",)),
    ("TaskInstanceSuccess", (), ("task_instance_success",)),
    ("TaskInstanceFailed", (), ("task_instance_failed",)),
)


def _kind(state: Column, event: Column) -> Column:
    out = None
    for name, states, events in KINDS:
        hit = F.coalesce(event.isin(list(events)), F.lit(False))
        if states:
            hit = hit | F.coalesce(state.isin(list(states)), F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("Unknown"))


def events(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Parsed events; works on a batch table and on a stream."""
    p = payloads.select(
        *[c for c in payloads.columns if c != text], F.from_json(F.col(text), PAYLOAD).alias("p")
    ).where("p.dag_id IS NOT NULL")
    kept = [c for c in payloads.columns if c != text]
    kind = _kind(F.col("p.state"), F.col("p.event"))
    when = F.col("p.execution_date")
    dag = F.lower("p.dag_id")
    out = p.select(
        *kept,
        kind.alias("event"),
        F.when(
            kind == "Unknown", F.coalesce("p.event", "p.state", F.lit("no_event"))
        ).alias("unknown_event"),
        F.col("p.dag_id").alias("dag_id"),
        F.coalesce("p.run_id", F.lit("")).alias("run_id"),
        F.when(when.rlike(RFC3339), F.try_to_timestamp(F.upper(when))).alias("execution_date"),
        F.col("p.duration").alias("duration_seconds"),
        F.col("p.task_id").alias("task_id"),
        F.col("p.dag_run_url").alias("dag_run_url"),
        F.translate(F.regexp_replace(dag, LOAD_PREFIX, ""), "_", ".").alias("affected_table"),
    )
    success = F.col("event").isin("DagRunSuccess", "TaskInstanceSuccess")
    failure = F.col("event").isin("DagRunFailed", "TaskInstanceFailed")
    return out.withColumns(
        {"is_success": success, "is_failure": failure, "is_terminal": success | failure}
    )


def rejected(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """The rows that ``events`` cannot use, whole, with the reason."""
    parsed = F.from_json(F.col(text), PAYLOAD, {"mode": "PERMISSIVE"})
    fields = F.try_parse_json(F.col(text))
    reason = F.when(F.col(text).isNull(), F.lit("empty")).when(fields.isNull(), F.lit("not JSON")).otherwise(F.lit("no dag_id"))
    return payloads.where(parsed["dag_id"].isNull()).withColumn("reason", reason)


def pipeline_status(parsed: DataFrame, at: str = "execution_date") -> DataFrame:
    """Rows (pipeline, table_name, last_success, status): one partial aggregate per pipeline."""
    return parsed.groupBy(F.col("dag_id").alias("pipeline"), F.col("affected_table").alias("table_name")).agg(
        F.max(F.when(F.col("is_success"), F.col(at))).alias("last_success"),
        F.max_by("event", F.struct(F.col(at), "event")).alias("status"),
    )
