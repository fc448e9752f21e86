"""Freshness and volume of a table, as a whole or per segment."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.arrays import array_mean, auto_threshold
from ...functions.numeric import ratio
from ...functions.timing import instant, iso_utc, literal_instant, seconds_between
from ...functions.text import say
from ...results import CRITICAL, INFO, WARNING, details, monitor_results, severity_of
from ...sources.history import recent_scores
from .config import Freshness, ThresholdConfig, Volume

# Rules of the volume monitor.
MIN_VOLUME_HISTORY = 3
COLD_SHARE = 0.5
HIGH, LOW, VERY_HIGH, VERY_LOW = 1.5, 0.1, 2.0, 0.05


def monitor_key(base: str, by: Sequence[str]) -> Column:
    """Monitor id, extended by the segment values."""
    if not by:
        return F.lit(base)
    return F.concat_ws(":", F.lit(base), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by])


def learned_limit(scores: Column, t: ThresholdConfig, clamp: bool = True) -> Column:
    if t.method == "fixed":
        return F.lit(float(t.fixed))
    low, high = (t.min_threshold, t.max_threshold) if clamp else (0.0, None)
    return auto_threshold(scores, t.method, t.sensitivity, low, high)


def freshness_metrics(cfg: Freshness) -> dict[str, Column]:
    return {"last": F.max(instant(cfg.ts_column))}


def check_freshness(
    df: DataFrame, cfg: Freshness, as_of: datetime | str | Column, history: DataFrame | None = None
) -> DataFrame:
    """Age of the newest row; the limit grows with the ages seen before, never below max age."""
    newest = df.groupBy(*cfg.by).agg(*(e.alias(name) for name, e in freshness_metrics(cfg).items()))
    return freshness_results(newest, cfg, as_of, history)


def freshness_results(
    newest: DataFrame, cfg: Freshness, as_of: datetime | str | Column, history: DataFrame | None = None
) -> DataFrame:
    """Results from rows (by..., last)."""
    now = literal_instant(as_of)
    rows = newest.select(
        monitor_key(cfg.id, cfg.by).alias("monitor_id"),
        "last",
        seconds_between(now, F.col("last")).cast("double").alias("age"),
    )
    limit = F.lit(float(cfg.max_age_seconds))
    if cfg.auto_threshold and history is not None:
        past = recent_scores(history, cfg.threshold.window_size, now)
        rows = rows.join(past, "monitor_id", "left")
        mad = ThresholdConfig(method="mad", sensitivity=cfg.threshold.sensitivity)
        learned = learned_limit(F.col("scores"), mad, clamp=False)
        limit = F.when(F.size("scores") > 0, F.greatest(learned, limit)).otherwise(limit)
    rows = rows.withColumn("limit", limit)
    age, limit = F.col("age"), F.col("limit")
    alert = F.coalesce(age > limit, F.lit(False))
    whole = lambda c: c.cast("bigint")
    message = (
        F.when(age.isNull(), say("Freshness unknown: table '%s' has no data", F.lit(cfg.table)))
        .when(
            alert,
            say(
                "Freshness alert: table '%s' last updated %ds ago (threshold: %ds)",
                F.lit(cfg.table), whole(age), whole(limit),
            ),
        )
        .otherwise(say("Freshness OK: table '%s' updated %ds ago", F.lit(cfg.table), whole(age)))
    )
    return monitor_results(
        rows,
        monitor_id=F.col("monitor_id"),
        monitor_type="freshness",
        table_name=cfg.table,
        alert=alert,
        severity=severity_of(alert, age > limit * 2.0),
        score=age,
        threshold=limit,
        message=message,
        details=details(age_seconds=age, threshold=limit, last_data_time=iso_utc(F.col("last"))),
        ts=now,
    )


def volume_timeline(
    df: DataFrame, ts_column: str, bucket: str, by: Sequence[str] = (), longest_gap: int | None = None
) -> DataFrame:
    """Rows (by..., bucket_start, row_count, buckets) without gaps: empty buckets count 0.

    A segment starts at its first row and ends at the last bucket of the table. ``buckets`` is the number of buckets a
    row stands for. With ``longest_gap``, a run of more empty buckets than that is told by as many rows, of which the
    last stands for the rest of the run: the rows are then bounded by the buckets that hold something, and one row
    with a time stamp far back costs no row per bucket since. Without it, every bucket is a row.
    """
    span = F.window(instant(ts_column), bucket)
    counts = (
        df.where(F.col(ts_column).isNotNull())
        .groupBy(*by, span.alias("_span"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(*by, F.col("_span.start").alias("bucket_start"), F.col("_span.end").alias("_end"), "row_count")
    )
    # the end of the table's last bucket closes the last run of every segment
    closing = counts.agg(F.max("_end")).scalar()
    following = F.lead("bucket_start").over(Window.partitionBy(*by).orderBy("bucket_start"))
    start, end = F.unix_micros("bucket_start"), F.unix_micros("_end")
    runs = counts.withColumn("_empty", (F.unix_micros(F.coalesce(following, closing)) - end).cast("bigint"))
    runs = runs.withColumns({"_step": end - start, "_empty": F.expr("_empty div (unix_micros(_end) - unix_micros(bucket_start))")})
    told = F.col("_empty") if longest_gap is None else F.least("_empty", F.lit(longest_gap).cast("bigint"))
    rows = runs.withColumn("_told", told).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_told"))))
    held = F.col("_k") == 0
    return rows.select(
        *by,
        F.timestamp_micros(F.unix_micros("bucket_start") + F.col("_k") * F.col("_step")).alias("bucket_start"),
        F.when(held, F.col("row_count")).otherwise(F.lit(0)).cast("bigint").alias("row_count"),
        F.when(~held & (F.col("_k") == F.col("_told")), F.col("_empty") - F.col("_told") + 1).otherwise(F.lit(1)).cast("bigint").alias("buckets"),
    )


def volume_rule(count: Column, limit: Column, cold: Column, quiet: bool) -> tuple[Column, Column]:
    """(alert, critical) of a count against its limit."""
    off = (count > limit * HIGH) | (count < limit * LOW)
    far = (count > limit * VERY_HIGH) | (count < limit * VERY_LOW)
    if quiet:
        # Nothing to compare with yet: only an empty table is an alert.
        return F.when(cold, count == 0).otherwise(off), (count == 0) | (~cold & far)
    return off, (count == 0) | far


def score_volume(timeline: DataFrame, cfg: Volume) -> DataFrame:
    """Monitor results of a timeline (by..., bucket_start, row_count).

    A row that stands for several empty buckets (``buckets``) has their number in its details.
    """
    t = cfg.threshold
    upto = Window.partitionBy("monitor_id").orderBy("bucket_start").rowsBetween(-(t.window_size - 1), 0)
    rows = timeline.withColumn("monitor_id", monitor_key(cfg.id, cfg.by))
    if "buckets" not in timeline.columns:
        rows = rows.withColumn("buckets", F.lit(1).cast("bigint"))
    rows = rows.withColumn("seen", F.collect_list(F.col("row_count").cast("double")).over(upto))
    count, n = F.col("row_count").cast("double"), F.size("seen")
    fixed = t.method == "fixed"
    if fixed:
        cold, limit = F.lit(False), F.lit(float(t.fixed))
    elif cfg.auto_threshold:
        cold = n <= MIN_VOLUME_HISTORY
        limit = F.when(cold, count * COLD_SHARE).otherwise(learned_limit(F.col("seen"), t))
    else:
        cold, limit = F.lit(True), count * COLD_SHARE
    baseline = array_mean(F.slice("seen", F.lit(1), F.greatest(n - 1, F.lit(0))))
    change = F.when((n > 1) & (baseline > 0), ratio(count - baseline, baseline, 0.0) * 100.0)
    rows = rows.select(
        "monitor_id", "bucket_start", "row_count", "buckets",
        count.alias("count"), n.alias("n"), cold.alias("cold"), limit.alias("limit"),
        F.coalesce(change, F.lit(0.0)).alias("change"),
    )
    count, limit = F.col("count"), F.col("limit")
    off, critical = volume_rule(count, limit, F.col("cold"), cfg.cold_start == "quiet")
    if fixed:
        critical = count == 0
    rows = rows.select("*", off.alias("alert"), critical.alias("critical"))
    name, alert = F.lit(cfg.table), F.col("alert")
    if fixed:
        text = say("Volume alert: table '%s' has %d rows", name, F.col("row_count"))
    else:
        text = say(
            "Volume alert: table '%s' has %d rows (change: %.1f%%)", name, F.col("row_count"), F.col("change")
        )
    entries = {"row_count": count, "threshold": limit, "buckets": F.when(F.col("buckets") > 1, F.col("buckets"))}
    if not fixed:
        entries |= {"pct_change": F.col("change"), "history_len": F.col("n")}
    return monitor_results(
        rows,
        monitor_id=F.col("monitor_id"),
        monitor_type="volume",
        table_name=cfg.table,
        alert=alert,
        severity=F.when(~alert, F.lit(INFO))
        .when(F.col("critical"), F.lit(CRITICAL))
        .otherwise(F.lit(WARNING)),
        score=count,
        threshold=limit,
        message=F.when(alert, text).otherwise(
            say("Volume OK: table '%s' has %d rows", name, F.col("row_count"))
        ),
        details=details(**entries),
        ts=F.col("bucket_start"),
    )


def check_volume(df: DataFrame, cfg: Volume) -> DataFrame:
    """Row count per time bucket against a limit learned from the last buckets, this one included.

    Behind as many empty buckets as the limit looks back, nothing changes until rows come again, so the rest of such a gap
    is one result: stamped with its first bucket, with the number of ``buckets`` in its details.
    """
    timeline = volume_timeline(df, cfg.ts_column, cfg.bucket, cfg.by, cfg.threshold.window_size)
    return score_volume(timeline, cfg)
