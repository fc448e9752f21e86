"""Root-cause hints for monitor results, as columns over the results table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.timing import instant, iso_utc
from ..functions.text import say
from ..operators.prefix_max import greatest_so_far
from ..results import detail_double
from ..sources.history import LATEST_DEFAULT, latest_n

# History needed before causal hints are given.
MIN_CAUSAL_ROWS = 3
GRANGER_LAG = 2


def causal_stats(history: DataFrame, n: int = LATEST_DEFAULT) -> DataFrame:
    """Rows (monitor_id, history_rows, granger_f, pca_share) over the latest ``n`` scores.

    ``granger_f`` compares the error of predicting a score by the one before with that of
    predicting it by the one two steps back; kept when finite and positive. ``pca_share``
    is the distance of the last score from the mean in population sigmas, at most 1.
    """
    recent = latest_n(history, n)
    # At most n rows per monitor.
    order = Window.partitionBy("monitor_id").orderBy(F.col("recency").desc())
    steps = recent.select(
        "monitor_id", "score", "recency",
        F.lag("score", 1).over(order).alias("p1"),
        F.lag("score", GRANGER_LAG).over(order).alias("p2"),
    )
    s, p1, p2 = F.col("score"), F.col("p1"), F.col("p2")
    known = p2.isNotNull()
    stats = steps.groupBy("monitor_id").agg(
        F.count(F.lit(1)).alias("history_rows"),
        F.sum(F.when(known, (s - p1) * (s - p1))).alias("r"),
        F.sum(F.when(known, (s - p2) * (s - p2))).alias("u"),
        F.max_by("score", -F.col("recency")).alias("last"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("sigma"),
    )
    rows = F.col("history_rows")
    f = F.try_divide(
        (F.col("r") - F.col("u")) / F.lit(float(GRANGER_LAG)),
        ratio(F.col("u"), rows - GRANGER_LAG),
    )
    pca = F.least(F.lit(1.0), F.abs(F.col("last") - F.col("mean")) / F.greatest("sigma", F.lit(1e-10)))
    return stats.select(
        "monitor_id",
        "history_rows",
        F.when((rows >= GRANGER_LAG + 3) & (f > 0), f).alias("granger_f"),
        F.when((rows >= MIN_CAUSAL_ROWS) & (F.col("sigma") > 0), pca).alias("pca_share"),
    )


def dimension_isolation(
    df: DataFrame,
    dimensions: Sequence[str],
    before: Column,
    after: Column,
    measure: Column | None = None,
) -> DataFrame:
    """Rows (dimension, segment, before, after, change, share): the segment that moved most.

    One scan for all dimensions: a row is expanded per dimension and collapses in the
    partial aggregate. ``share`` is the segment's part of the total absolute change.
    """
    amount = F.lit(1.0) if measure is None else measure.cast("double")
    entries = [
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("null")).alias("segment"))
        for d in dimensions
    ]
    segments = (
        df.select(
            F.when(before, amount).alias("_b"),
            F.when(after, amount).alias("_a"),
            F.inline(F.array(*entries)),
        )
        .where("_b IS NOT NULL OR _a IS NOT NULL")
        .groupBy("dimension", "segment")
        .agg(
            F.coalesce(F.sum("_b"), F.lit(0.0)).alias("before"),
            F.coalesce(F.sum("_a"), F.lit(0.0)).alias("after"),
        )
    )
    change = F.col("after") - F.col("before")
    best = F.max(F.struct(F.abs(change).alias("size"), "segment", "before", "after")).alias("top")
    top = segments.groupBy("dimension").agg(best, F.sum(F.abs(change)).alias("total"))
    return top.select(
        "dimension",
        F.col("top.segment").alias("segment"),
        F.col("top.before").alias("before"),
        F.col("top.after").alias("after"),
        (F.col("top.after") - F.col("top.before")).alias("change"),
        ratio(F.col("top.size"), F.col("total"), 0.0).alias("share"),
    )


def recent_deployments(results: DataFrame, deployments: DataFrame, window_seconds: int) -> DataFrame:
    """Rows (monitor_id, ts, deployment, deployed_at): the newest deployment within the window.

    An as-of match without pairing anything: the newest deployment so far, by ranges of time.
    """
    shipped = deployments.select(instant("deployed_at").alias("ts"), F.struct(instant("deployed_at").alias("at"), "name").alias("d"))
    alerts = results.select("monitor_id", "ts").distinct()
    found = greatest_so_far(alerts, shipped, [], "ts", "d")
    in_reach = F.unix_micros("ts") - F.unix_micros("d.at") <= window_seconds * 1_000_000
    return found.where(in_reach).select("monitor_id", "ts", F.col("d.name").alias("deployment"), F.col("d.at").alias("deployed_at"))


def _say(text: str, *args: Column) -> Column:
    return say(text, *args) if args else F.lit(text)


def _rules() -> dict[str, list[Column]]:
    """Hints per monitor type; a null entry is dropped. Texts are fixed values."""
    table, score, limit = F.col("table_name"), F.col("score"), F.col("threshold")
    num = lambda key, default=0.0: detail_double(F.col("details"), key, default)
    text = lambda key, default: F.coalesce(
        F.try_element_at("details", F.lit(key)), F.lit(default)
    )
    rows, change = num("row_count"), num("pct_change")
    pipeline, last = F.col("_pipeline"), F.col("_last_success")
    upstream = pipeline.isNotNull()
    orphans, total = num("orphan_count"), num("total_rows", 1.0)
    return {
        "volume": [
            F.when(
                rows == 0,
                _say("Table '%s' has 0 rows — possible upstream pipeline failure or source table empty", table),
            )
            .when(
                change < -50,
                _say(
                    "Volume dropped %.0f%% — check for upstream filter changes, partition pruning, "
                    "or source disconnection",
                    change,
                ),
            )
            .when(
                change > 100,
                _say(
                    "Volume surged %.0f%% — possible data duplication, backfill, or upstream row explosion",
                    change,
                ),
            ),
            F.when(upstream, _say("Last successful run of upstream pipeline '%s' was at %s", pipeline, last)),
        ],
        "freshness": [
            _say("Data in '%s' is %.1fh old — expected max %.0fs", table, num("age_seconds") / 3600.0, limit),
            F.when(upstream, _say("Pipeline '%s' last ran at %s — may be stalled or failed", pipeline, last)),
            F.when(upstream, _say("Check scheduler logs for pipeline '%s' around %s", pipeline, last)),
            _say("Verify that upstream source is still producing data and the connection is active"),
        ],
        "schema": [
            _say("Schema changes often correlate with application deployments or ETL code changes")
        ],
        "distribution": [
            _say(
                "Distribution drift detected via %s (score=%.4f, threshold=%.4f)",
                text("metric", "unknown"), F.coalesce(score, F.lit(0.0)), limit,
            ),
            _say(
                "Possible causes: upstream business logic changed, new data source, seasonality effect, "
                "or data corruption"
            ),
            _say(
                "Compare the failing distribution against a known-good reference period to isolate "
                "which values changed most"
            ),
        ],
        "correlation": [
            _say(
                "Correlation between '%s' and '%s' changed to %.4f (threshold: %.4f)",
                text("column_x", "?"), text("column_y", "?"), num("correlation"), num("threshold"),
            ),
            _say(
                "Possible causes: business logic change affecting one column, data quality issue in "
                "join key, or shifted data distribution"
            ),
        ],
        "uniqueness": [
            _say(
                "Duplicate ratio %.2f%% exceeds threshold — check for upstream dedup logic failures or "
                "repeated data loads",
                num("duplicate_ratio") * 100.0,
            ),
            _say("Common causes: missing DISTINCT in pipeline, repeated ingestion, or join explosion"),
        ],
        "referential": [
            _say(
                "Referential integrity violation: %.0f orphan rows (%.1f%%)",
                orphans, orphans / F.greatest(total, F.lit(1.0)) * 100.0,
            ),
            _say(
                "Possible causes: source table deleted rows without cascade, ETL order-of-operations "
                "changed, or data cleanup scripts running"
            ),
        ],
        "custom_sql": [
            _say(
                "Custom SQL check returned %.4f — review query logic for upstream changes", num("observed")
            ),
            _say("Check if source schema changed, data volume shifted, or business rules were updated"),
        ],
        "ml_drift": [
            _say(
                "ML drift detected for model '%s' on metric '%s' (score=%.4f)",
                text("model_name", "unknown"), text("drift_metric", "unknown"),
                F.coalesce(score, F.lit(0.0)),
            ),
            _say(
                "Check for training-serving skew, data distribution shift in upstream features, or "
                "model staleness"
            ),
            _say("Consider retraining the model or reviewing feature engineering pipeline for changes"),
        ],
        "cost": [
            _say(
                "Cost anomaly for resource '%s': actual=%.2f, budget=%.2f",
                text("resource_type", "unknown"), score, limit,
            ),
            _say(
                "Possible causes: query pattern changed, data volume increased, inefficient joins, or "
                "pricing model changes"
            ),
            _say(
                "Review recent query performance metrics and consider adding resource limits or query "
                "optimization"
            ),
        ],
    }


def _schema_change_hints() -> Column:
    changes = F.from_json(F.try_element_at("details", F.lit("changes")), "array<string>")
    hint = lambda c: (
        F.when(
            c.startswith("+"),
            say("New column detected: %s — possible schema migration or new data source version", c),
        )
        .when(
            c.startswith("-"),
            say("Column removed: %s — possible schema migration or column deprecation", c),
        )
        .when(
            c.startswith("~"),
            say("Column type changed: %s — possible schema migration or data type update", c),
        )
    )
    return F.coalesce(F.transform(changes, hint), F.array().cast("array<string>"))


def with_hints(
    results: DataFrame,
    pipelines: DataFrame | None = None,
    history: DataFrame | None = None,
    dimensions: DataFrame | None = None,
    deployments: DataFrame | None = None,
    deployment_window_seconds: int = 86_400,
    history_rows: int = LATEST_DEFAULT,
) -> DataFrame:
    """Monitor results with ``root_cause_hints ARRAY<STRING>``.

    ``pipelines``: (table_name, pipeline, last_success) - the newest success per table is
    used. ``history``: earlier scores, needed for causal hints. ``dimensions``:
    (monitor_id, segment). ``deployments``: (name, deployed_at).
    """
    text = lambda c: F.lit(None).cast("string").alias(c)
    out = results
    if pipelines is not None:
        newest = pipelines.groupBy("table_name").agg(
            F.max_by(F.struct("pipeline", "last_success"), F.struct("last_success", "pipeline")).alias("p")
        )
        out = out.join(
            newest.select(
                "table_name",
                F.col("p.pipeline").alias("_pipeline"),
                iso_utc(instant("p.last_success")).alias("_last_success"),
            ),
            "table_name",
            "left",
        )
    else:
        out = out.select("*", text("_pipeline"), text("_last_success"))
    if history is not None:
        out = out.join(causal_stats(history, history_rows), "monitor_id", "left")
    else:
        none = F.lit(None).cast("double")
        out = out.withColumns({"history_rows": F.lit(0).cast("bigint"), "granger_f": none, "pca_share": none})
    if dimensions is not None:
        out = out.join(dimensions.select("monitor_id", F.col("segment").alias("_segment")), "monitor_id", "left")
    else:
        out = out.select("*", text("_segment"))
    if deployments is not None:
        found = recent_deployments(results, deployments, deployment_window_seconds)
        out = out.join(
            found.select(
                "monitor_id", "ts",
                F.col("deployment").alias("_deployment"), iso_utc(F.col("deployed_at")).alias("_deployed"),
            ),
            ["monitor_id", "ts"],
            "left",
        )
    else:
        out = out.select("*", text("_deployment"), text("_deployed"))

    empty = F.array().cast("array<string>")
    own = empty
    for kind, hints in _rules().items():
        listed = F.array(*hints)
        if kind == "schema":
            listed = F.concat(_schema_change_hints(), listed)
        own = F.when(F.col("monitor_type") == kind, listed).otherwise(own)
    causal = F.array(
        F.when(
            F.col("granger_f").isNotNull(),
            say(
                "[Granger causality] Past values predict current anomaly (F=%.4f)", "granger_f"
            ),
        ),
        F.when(
            F.col("pca_share").isNotNull(),
            say(
                "[PCA] Top dimension contributed %.1f%% to anomaly score", F.col("pca_share") * 100.0
            ),
        ),
        F.when(
            F.col("_segment").isNotNull(),
            say("[Dimension isolation] Segment '%s' drove the change", "_segment"),
        ),
        F.when(
            F.col("_deployment").isNotNull(),
            say(
                "[Deployment correlation] '%s' deployed at %s — within anomaly window",
                "_deployment", "_deployed",
            ),
        ),
    )
    gated = F.when(F.col("history_rows") >= MIN_CAUSAL_ROWS, causal).otherwise(empty)
    hints = F.array_compact(F.concat(own, gated)).alias("root_cause_hints")
    return out.select(*results.columns, hints)
