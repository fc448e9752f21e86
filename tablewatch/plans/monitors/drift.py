"""Distribution and model drift."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.numeric import as_double
from ...functions.timing import literal_instant
from ...functions.text import say
from ...operators.chi_square import CRITICAL_5_PERCENT, chi_square_drift
from ...operators.histogram import js_drift
from ...operators.ks import ks_drift
from ...operators.local_rows import union_all
from ...results import details, monitor_results, severity_of
from ...sources.history import recent_scores
from .config import Distribution, MlDrift
from .table_metrics import learned_limit

# Limits used until enough history is there.
DEFAULT_LIMITS = {
    "ks": 0.3,
    "js": 0.1,
    "chi_square": CRITICAL_5_PERCENT,
    "categorical": CRITICAL_5_PERCENT,
}
# Decimals of a score: limits and texts see the number that the results show, so a text's own rounding cannot disagree with it.
DIGITS = {"ks": 9, "chi_square": 6, "categorical": 6}
# Fixed value: a limit is learned once there are more scores than this.
MIN_DRIFT_HISTORY = 5


def _scores(
    df: DataFrame, cfg: Distribution, reference: Column, targets: Mapping[str, Column],
    weight: Column | None = None,
) -> DataFrame:
    """Rows (name, score, n_reference, n_target) of the configured metric."""
    if cfg.metric == "ks":
        out = ks_drift(df, cfg.column, reference, targets, weight=weight)
    elif cfg.metric == "js":
        out = js_drift(df, cfg.column, reference, targets, cfg.bins, weight)
    elif cfg.metric == "chi_square":
        out = chi_square_drift(df, as_double(cfg.column), reference, targets, weight=weight)
    elif cfg.metric == "categorical":
        out = chi_square_drift(df, cfg.column, reference, targets, weight=weight)
    else:
        raise ValueError(f"unknown drift metric {cfg.metric!r}")
    score = F.round("score", DIGITS[cfg.metric]) if cfg.metric in DIGITS else F.col("score")
    return out.select("name", score.alias("score"), "n_reference", "n_target")


def _results(scored: DataFrame, cfg: Distribution, ts: Column) -> DataFrame:
    """``scored``: monitor_id, score, n_reference, n_target, past (array or null)."""
    fallback = F.lit(DEFAULT_LIMITS[cfg.metric])
    limit = fallback
    if cfg.auto_threshold and cfg.metric in ("ks", "js"):
        learned = learned_limit(F.col("past"), cfg.threshold, clamp=False)
        limit = F.when(F.size("past") > MIN_DRIFT_HISTORY, learned).otherwise(fallback)
    rows = scored.withColumn("limit", limit)
    score, limit = F.col("score"), F.col("limit")
    alert = F.coalesce(score > limit, F.lit(False))
    table, metric = F.lit(cfg.table), F.lit(cfg.metric)
    empty = say("Distribution unknown on '%s': empty sample", table)
    if cfg.metric == "categorical":
        bad = say("Categorical distribution drift on '%s': chi-sq=%.4f", table, score)
        good = say("Categorical distribution OK on '%s': chi-sq=%.4f", table, score)
    else:
        bad = say(
            "Distribution drift detected on '%s': %s score=%.4f (threshold=%.4f)", table, metric, score, limit
        )
        good = say("Distribution OK on '%s': %s score=%.4f", table, metric, score)
    critical = F.lit(False) if cfg.metric == "categorical" else score > limit * 2.0
    return monitor_results(
        rows,
        monitor_id=F.col("monitor_id"),
        monitor_type="distribution",
        table_name=cfg.table,
        alert=alert,
        severity=severity_of(alert, critical),
        score=score,
        threshold=limit,
        message=F.when(score.isNull(), empty).when(alert, bad).otherwise(good),
        details=details(
            metric=metric,
            column=F.lit(cfg.column),
            score=score,
            threshold=limit,
            reference_count=F.col("n_reference"),
            target_count=F.col("n_target"),
        ),
        ts=ts,
    )


def check_distribution(
    df: DataFrame, cfg: Distribution, as_of: datetime | str | Column, history: DataFrame | None = None
) -> DataFrame:
    """One result: the target rows of ``df`` against its reference rows."""
    target = F.expr(cfg.target)
    reference = F.expr(cfg.reference) if cfg.reference else target
    now = literal_instant(as_of)
    scored = _scores(df, cfg, reference, {cfg.id: target}).withColumnRenamed("name", "monitor_id")
    return _results(_with_past(scored, cfg, history, now), cfg, now)


def _with_past(scored: DataFrame, cfg: Distribution, history: DataFrame | None, now: Column) -> DataFrame:
    if history is None:
        return scored.withColumn("past", F.lit(None).cast("array<double>"))
    past = recent_scores(history, cfg.threshold.window_size, now).withColumnRenamed("scores", "past")
    return scored.join(past, "monitor_id", "left")


def drift_series(
    df: DataFrame, cfg: Distribution, targets: Mapping[str, str]
) -> DataFrame:
    """One result per target period, each limit learned from the scores before it.

    ``targets`` maps the instant of a period (ISO text) to its row condition. All periods
    share one pass over the table.
    """
    reference = F.expr(cfg.reference)
    scored = _scores(df, cfg, reference, {k: F.expr(c) for k, c in targets.items()})
    # One row per period.
    before = Window.partitionBy("monitor_id").orderBy("at").rowsBetween(-cfg.threshold.window_size, -1)
    series = (
        scored.select("*", F.lit(cfg.id).alias("monitor_id"), F.col("name").cast("timestamp").alias("at"))
        .withColumn("past", F.collect_list("score").over(before))
    )
    return _results(series, cfg, F.col("at"))


def capture_reference(df: DataFrame, column: str) -> DataFrame:
    """A baseline to store: rows (value, n), the value counts of a column."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def against_summary(
    df: DataFrame, cfg: Distribution, summary: DataFrame, as_of: datetime | str | Column,
    history: DataFrame | None = None,
) -> DataFrame:
    """Like ``check_distribution`` with a stored baseline; only the target is scanned."""
    both = df.where(F.expr(cfg.target)).select(
        F.col(cfg.column), F.lit(1).cast("bigint").alias("_w"), F.lit(False).alias("_ref")
    ).unionByName(
        summary.select(F.col("value").alias(cfg.column), F.col("n").alias("_w"), F.lit(True).alias("_ref"))
    )
    now = literal_instant(as_of)
    scored = _scores(both, cfg, F.col("_ref"), {cfg.id: ~F.col("_ref")}, F.col("_w"))
    scored = scored.withColumnRenamed("name", "monitor_id")
    return _results(_with_past(scored, cfg, history, now), cfg, now)


def _ml_scores(df: DataFrame, cfg: MlDrift) -> DataFrame:
    """Rows (feature, score): drift per column, or the drop in accuracy."""
    baseline, current = F.expr(cfg.baseline), F.expr(cfg.current)
    if cfg.metric == "accuracy_drop":
        (prediction,) = cfg.columns
        hit = (F.col(prediction) == F.col(cfg.label)).cast("double")
        return df.agg(
            (F.avg(F.when(baseline, hit)) - F.avg(F.when(current, hit))).alias("score")
        ).select(F.lit(prediction).alias("feature"), "score")
    drift = {"js": js_drift, "ks": ks_drift}[cfg.statistic]
    return union_all(
        [
            drift(df, c, baseline, {c: current}).select(F.col("name").alias("feature"), "score")
            for c in cfg.columns
        ]
    )


def check_ml_drift(df: DataFrame, cfg: MlDrift, as_of: datetime | str | Column) -> DataFrame:
    """One result per feature (or one for predictions and accuracy) against a limit."""
    rows = _ml_scores(df, cfg)
    score, limit = F.col("score"), F.lit(float(cfg.limit))
    alert = F.coalesce(score > limit, F.lit(False))
    model, metric = F.lit(cfg.model), F.lit(cfg.metric)
    bad = say("ML drift alert: model '%s' %s=%.4f (threshold=%.4f)", model, metric, score, limit)
    good = say("ML drift OK: model '%s' %s=%.4f", model, metric, score)
    monitor_id = F.lit(cfg.id)
    if cfg.metric == "feature_drift":
        monitor_id = F.concat_ws(":", monitor_id, "feature")
    return monitor_results(
        rows,
        monitor_id=monitor_id,
        monitor_type="ml_drift",
        table_name=cfg.table,
        alert=alert,
        severity=severity_of(alert, score > limit * 2.0),
        score=score,
        threshold=limit,
        message=F.when(
            score.isNull(), say("ML drift unknown: model '%s' has an empty sample", model)
        ).when(alert, bad).otherwise(good),
        details=details(model_name=model, drift_metric=metric, feature=F.col("feature"), threshold=limit),
        ts=literal_instant(as_of),
    )


