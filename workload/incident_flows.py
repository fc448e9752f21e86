"""Incidents from events: every event is a monitor result with its own time and severity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.plans import incidents as I

from .common import spread, stamp, table

UNION = "\nUNION ALL\n"
# A repeat within the hour of the last kept incident is a duplicate.
WINDOW = 3600


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("value")
    severity = F.when(score > 60, "CRITICAL").when(score > 30, "WARNING").otherwise("INFO")
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        F.concat(F.lit("mon-"), "event_type").alias("monitor_id"),
        F.lit("custom_sql").alias("monitor_type"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("table_name"),
        (score > 30).alias("alert"),
        severity.alias("severity"),
        score.alias("score"),
        F.lit(30.0).alias("threshold"),
        F.format_string("value %.2f from user %d.", score, F.col("user_id")).alias("message"),
        F.create_map(F.lit("observed"), score.cast("string")).alias("details"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.array(F.format_string("event %d", "event_id"), F.lit("check the source")).alias("root_cause_hints"),
        F.col("event_id").alias("result_id"),
    )


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hours of maintenance after every very large error; for all monitors when the user is even."""
    return table(spark, sf_dir, "events").where("event_type = 'error' AND value > 80").select(
        F.when(F.col("user_id") % 2 == 0, F.lit(None).cast("string")).otherwise("mon-click").alias("monitor_id"),
        F.col("ts").alias("starts_at"),
        (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("ends_at"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per nation: a user's messages, of one monitor or of all, some of them expired."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.when(F.col("n_regionkey") == 1, "mon-view").alias("monitor_id"),
        F.concat(F.lit("user "), key.cast("string"), F.lit(".")).alias("pattern"),
        F.when(key % 2 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("expires_at"),
    )


_EVENTS = """ev AS (
  SELECT event_id, 'mon-' || event_type AS monitor_id, 't' || (user_id % 3) AS table_name, value, user_id, ts,
    'mon-' || event_type || ':t' || (user_id % 3) AS group_key,
    sha256('mon-' || event_type || '|t' || (user_id % 3) || '|' || epoch_us(ts)) AS incident_id,
    printf('value %.2f from user ', value) || user_id || '.' AS text,
    CASE WHEN value > 60 THEN 'CRITICAL' WHEN value > 30 THEN 'WARNING' ELSE 'INFO' END AS sev
  FROM events)"""

_CHAIN = f"""chain AS (
  SELECT group_key, min(ts) AS ts FROM ev GROUP BY 1
  UNION ALL
  SELECT c.group_key, n.ts FROM chain c,
    LATERAL (SELECT min(e.ts) AS ts FROM ev e WHERE e.group_key = c.group_key AND e.ts >= c.ts + INTERVAL {WINDOW} SECOND) n
  WHERE n.ts IS NOT NULL)"""


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.register(results(spark, sf_dir), maintenance(spark, sf_dir), rules(spark, sf_dir), WINDOW)
    return out.select(
        "incident_id", "monitor_id", "table_name", "severity", "message", "group_key",
        F.array_join("root_cause_hints", ", ").alias("hints"), stamp("ts").alias("ts"),
    )


_REGISTER_SQL = f"""
WITH RECURSIVE {_EVENTS}, {_CHAIN},
win AS (SELECT CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'mon-click' END AS m, ts AS lo, ts + INTERVAL 2 HOUR AS hi
  FROM events WHERE event_type = 'error' AND value > 80),
rule AS (SELECT CASE WHEN n_regionkey = 1 THEN 'mon-view' END AS m, 'user ' || n_nationkey || '.' AS p,
  CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS until FROM nation),
flags AS (SELECT *,
    EXISTS (SELECT 1 FROM win w WHERE (w.m IS NULL OR w.m = ev.monitor_id) AND ev.ts BETWEEN w.lo AND w.hi) AS sup,
    EXISTS (SELECT 1 FROM rule q WHERE (q.m IS NULL OR q.m = ev.monitor_id) AND contains(ev.text, q.p)
      AND (q.until IS NULL OR ev.ts <= q.until)) AS ign,
    NOT EXISTS (SELECT 1 FROM chain c WHERE c.group_key = ev.group_key AND c.ts = ev.ts) AS dup
  FROM ev)
SELECT incident_id, monitor_id, table_name, CASE WHEN sup OR ign OR dup THEN 'INFO' ELSE sev END AS severity,
  CASE WHEN dup THEN '[DEDUP] ' ELSE '' END || CASE WHEN ign THEN '[IGNORED] ' ELSE '' END
    || CASE WHEN sup THEN '[SUPPRESSED] ' ELSE '' END || text AS message,
  group_key, 'event ' || event_id || ', check the source' AS hints, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM flags"""


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates of every event type within the hour of the last kept event."""
    events = table(spark, sf_dir, "events")
    marked = I.mark_duplicates(events, "event_type", "ts", "event_id", WINDOW)
    return marked.select("event_id", "event_type", "duplicate")


_DEDUP_SQL = f"""
WITH RECURSIVE ev AS (SELECT event_id, event_type AS group_key, ts FROM events), {_CHAIN}
SELECT event_id, group_key AS event_type,
  NOT EXISTS (SELECT 1 FROM chain c WHERE c.group_key = ev.group_key AND c.ts = ev.ts) AS duplicate FROM ev"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action log derived from the events: up to two of every kind per incident."""
    base = I.from_results(results(spark, sf_dir)).select("incident_id", "result_id", "ts", "message")
    value = F.regexp_extract("message", r"value ([0-9.]+)", 1).cast("double")
    user = F.regexp_extract("message", r"user ([0-9]+)", 1).cast("bigint")
    after = lambda minutes: F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES")

    def entry(when, action, minutes, actor=None, until=None, level=None):
        return F.when(
            when,
            F.struct(
                F.lit(action).alias("action"), after(minutes).alias("at"),
                (F.lit(None) if actor is None else actor).cast("string").alias("actor"),
                (F.lit(None) if until is None else until).cast("timestamp").alias("until"),
                (F.lit(None) if level is None else level).cast("int").alias("level"),
            ),
        )

    log = F.array(
        entry(value > 20, "resolve", 60),
        entry(user % 2 == 0, "acknowledge", 10, actor=F.concat(F.lit("u"), user.cast("string"))),
        entry(user % 4 == 0, "acknowledge", 20),
        entry(user % 3 == 0, "snooze", 5, until=after(120)),
        entry(user % 6 == 0, "snooze", 6, until=after(30)),
        entry(value > 10, "escalate", 15, level=F.lit(1)),
        entry(value > 40, "escalate", 30, level=F.lit(2)),
    )
    return base.select("incident_id", "result_id", F.inline(log)).where("action IS NOT NULL")


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.apply_actions(I.from_results(results(spark, sf_dir)), actions(spark, sf_dir))
    return out.select(
        "incident_id", "resolved", stamp("resolved_at").alias("resolved_at"), "acked",
        stamp("acknowledged_at").alias("acknowledged_at"), "owner", stamp("snoozed_until").alias("snoozed_until"),
        "escalation_level",
    )


def _time(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


_STATE_SQL = f"""
WITH {_EVENTS}
SELECT incident_id, value > 20 AS resolved,
  CASE WHEN value > 20 THEN {_time("ts + INTERVAL 60 MINUTE")} END AS resolved_at,
  user_id % 2 = 0 AS acked,
  CASE WHEN user_id % 4 = 0 THEN {_time("ts + INTERVAL 20 MINUTE")}
    WHEN user_id % 2 = 0 THEN {_time("ts + INTERVAL 10 MINUTE")} END AS acknowledged_at,
  CASE WHEN user_id % 2 = 0 THEN 'u' || user_id END AS owner,
  CASE WHEN user_id % 6 = 0 THEN {_time("ts + INTERVAL 30 MINUTE")}
    WHEN user_id % 3 = 0 THEN {_time("ts + INTERVAL 120 MINUTE")} END AS snoozed_until,
  CASE WHEN value > 40 THEN 2 WHEN value > 10 THEN 1 ELSE 0 END AS escalation_level
FROM ev"""


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and resolved incidents of one monitor, and open counts of all."""
    state = I.apply_actions(I.from_results(results(spark, sf_dir)), actions(spark, sf_dir))
    counts = I.open_counts(state)
    for status in ("open", "resolved"):
        part = I.list_incidents(state, status, "mon-error").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.withColumn(f"error_{status}", part.scalar())
    return counts


_LIST_SQL = f"""
WITH {_EVENTS}
SELECT monitor_id, count_if(value <= 20) AS open, count(*) AS total,
  (SELECT count(*) FROM ev WHERE monitor_id = 'mon-error' AND value <= 20) AS error_open,
  (SELECT count(*) FROM ev WHERE monitor_id = 'mon-error' AND value > 20) AS error_resolved
FROM ev GROUP BY 1"""

CHANNELS = (
    I.Channel("console", "text"), I.Channel("log", "json"), I.Channel("team", "chat"),
    I.Channel("oncall", "pager", "key-1"), I.Channel("hook", "webhook"),
)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload text per channel; whole documents are read back by field."""
    out = I.alert_payloads(I.from_results(results(spark, sf_dir)), CHANNELS)
    document = F.concat_ws(
        "/", *[F.get_json_object("payload", f"$.{k}") for k in ("incident_id", "monitor_id", "severity", "message", "root_cause_hints[1]")]
    )
    shown = F.when(F.col("kind").isin("json", "webhook"), document).otherwise(F.col("payload"))
    return out.select("incident_id", "channel", "kind", shown.alias("payload"))


_PAYLOADS_SQL = f"""
WITH {_EVENTS}, loud AS (SELECT *, 'event ' || event_id AS h1, 'check the source' AS h2 FROM ev WHERE sev <> 'INFO')
SELECT incident_id, 'console' AS channel, 'text' AS kind,
  '[' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z] [' || sev || '] ' || text || ' — monitor=' || monitor_id || ' hints=["' || h1
  || '", "' || h2 || '"]' || chr(10) || '  └─ ' || h1 || chr(10) || '  └─ ' || h2 AS payload FROM loud
UNION ALL
SELECT incident_id, channel, kind, incident_id || '/' || monitor_id || '/' || sev || '/' || text || '/' || h2
FROM loud, (VALUES ('log', 'json'), ('hook', 'webhook')) t(channel, kind)
UNION ALL
SELECT incident_id, 'team', 'chat', '{{"text":"[' || sev || '] ' || text || ' — monitor=' || monitor_id || '"}}' FROM loud
UNION ALL
SELECT incident_id, 'oncall', 'pager', '{{"routing_key":"key-1","event_action":"trigger","payload":{{"summary":"' || text
  || '","severity":"critical","source":"' || monitor_id || '"}}}}' FROM loud"""

QUERIES = {
    "incident_register": _register,
    "incident_dedup": _dedup,
    "incident_state": _state,
    "incident_list": _list,
    "alert_payloads": _payloads,
}
ORACLE = {
    "incident_register": _REGISTER_SQL,
    "incident_dedup": _DEDUP_SQL,
    "incident_state": _STATE_SQL,
    "incident_list": _LIST_SQL,
    "alert_payloads": _PAYLOADS_SQL,
}
