"""Running a set of configured monitors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.timing import literal_instant
from ...operators.local_rows import union_all
from ...results import CRITICAL, monitor_results
from ..isolate import FAILURES, kept, problem_of, settled
from . import checks, config, drift, shared_scan, table_metrics


def _check(
    cfg: config.MonitorConfig,
    tables: Mapping[str, DataFrame],
    as_of: datetime | str | Column,
    history: DataFrame | None,
    snapshots: DataFrame | None,
) -> DataFrame:
    df = tables[cfg.table]
    match cfg:
        case config.Freshness():
            return table_metrics.check_freshness(df, cfg, as_of, history)
        case config.Volume():
            return table_metrics.check_volume(df, cfg)
        case config.Schema():
            return checks.check_schema(cfg, checks.schema_snapshot(df, cfg.table), snapshots, as_of)
        case config.Distribution():
            return drift.check_distribution(df, cfg, as_of, history)
        case config.Correlation():
            return checks.check_correlation(df, cfg, as_of)
        case config.Uniqueness():
            return checks.check_uniqueness(df, cfg, as_of)
        case config.ReferentialIntegrity():
            return checks.check_referential(df, tables[cfg.target_table], cfg, as_of)
        case config.CustomSql():
            return checks.check_custom_sql(tables, cfg, as_of)
        case config.MlDrift():
            return drift.check_ml_drift(df, cfg, as_of)
        case config.Cost():
            budgets = tables[cfg.budget_table] if cfg.budget_table else None
            return checks.check_cost(df, cfg, as_of, budgets)
    raise TypeError(f"no monitor for {type(cfg).__name__}")


def _failed(some: DataFrame, cfg: config.MonitorConfig, problem: str, as_of: datetime | str | Column) -> DataFrame:
    """The row of a monitor that could not be planned: it alerts, and says why."""
    none = F.lit(None).cast("double")
    return monitor_results(
        some.sparkSession.range(1), monitor_id=F.lit(cfg.id), monitor_type="error", table_name=cfg.table, alert=F.lit(True),
        severity=F.lit(CRITICAL), score=none, threshold=none, message=F.lit(f"Monitor failed: {problem}"),
        details=F.create_map().cast("map<string,string>"), ts=literal_instant(as_of),
    )


def shared_frames(asks: Sequence[shared_scan.Ask], tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """By table, the one aggregation that answers all asks of it."""
    names = dict.fromkeys(ask.monitor.table for ask in asks)
    return {t: shared_scan.shared(tables[t], [a for a in asks if a.monitor.table == t]) for t in names}


def run_monitors(
    configs: Sequence[config.MonitorConfig],
    tables: Mapping[str, DataFrame],
    as_of: datetime | str | Column,
    history: DataFrame | None = None,
    snapshots: DataFrame | None = None,
    parallel: int = 4,
) -> DataFrame:
    """Results of every enabled monitor. The monitors run now, ``parallel`` at a time; the rows are read from files.

    Monitors that need only aggregates (freshness, Pearson, totals of a referential check, cost) share one scan of their
    table. A monitor that fails, when it is planned (unknown table or column, bad query) or while it runs (a division by
    zero, a failing function), gives a row that says so; the others are not touched by it. ``history`` holds earlier
    scores (``results.MONITOR_HISTORY``), ``snapshots`` the last known schemas.
    """
    enabled = [cfg for cfg in configs if cfg.enabled]
    if not enabled:
        raise ValueError("no enabled monitor")
    some = next(iter(tables.values()))
    failed = lambda cfg, problem: _failed(some, cfg, problem, as_of)
    asks: dict[str, list[shared_scan.Ask]] = {}
    parts: list[DataFrame] = []
    jobs: list[tuple[config.MonitorConfig, Callable[[], DataFrame]]] = []
    for cfg in enabled:
        try:
            ask = shared_scan.ask_of(cfg, tables, as_of, history)
            tables[cfg.table]
        except KeyError as missing:
            parts.append(failed(cfg, f"unknown table {missing}"))
            continue
        if ask:
            asks.setdefault(cfg.table, []).append(ask)
        else:
            jobs.append((cfg, lambda cfg=cfg: _check(cfg, tables, as_of, history, snapshots)))

    def scan(item):
        table, own = item
        return settled(own, lambda some_asks: shared_scan.shared(tables[table], some_asks), "monitors")

    def run(job):
        cfg, build = job
        try:
            return kept(build(), "monitors")
        except FAILURES as error:
            return failed(cfg, problem_of(error))

    with ThreadPoolExecutor(parallel) as pool:
        for answered, refused in pool.map(inheritable_thread_target(some.sparkSession)(scan), asks.items()):
            parts += [failed(ask.monitor, problem) for ask, problem in refused]
            for frame, own in answered:
                jobs += [(ask.monitor, lambda f=frame, o=own, a=ask: a.finish(shared_scan.answer(f, o, a))) for ask in own]
        parts += pool.map(inheritable_thread_target(some.sparkSession)(run), jobs)
    return union_all(parts)
