"""One scan of a table for all monitors that need only aggregates of it.

A monitor states what it asks of its table: grouping keys, aggregates, and how result rows follow from them. The asks of a
table become one ``agg``, over grouping sets where their keys differ, so a table of any size is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks, config, table_metrics

Instant = datetime | str | Column
_SET = "_set"


@dataclass(frozen=True)
class Ask:
    """``metrics`` are named aggregates; ``empty`` holds their values over no rows where that is not null."""

    monitor: config.MonitorConfig
    keys: tuple[str, ...]
    metrics: Mapping[str, Column]
    finish: Callable[[DataFrame], DataFrame]
    empty: Mapping[str, float] = field(default_factory=dict)


def ask_of(
    cfg: config.MonitorConfig, tables: Mapping[str, DataFrame], as_of: Instant, history: DataFrame | None
) -> Ask | None:
    """What a monitor asks of its table, or None if aggregates of one pass do not answer it."""
    match cfg:
        case config.Freshness():
            return Ask(
                cfg, tuple(cfg.by), table_metrics.freshness_metrics(cfg),
                lambda rows: table_metrics.freshness_results(rows, cfg, as_of, history),
            )
        case config.Correlation(method="pearson"):
            return Ask(
                cfg, (), checks.pearson_metrics(cfg), lambda rows: checks.correlation_results(rows, cfg, as_of), {"n": 0}
            )
        case config.ReferentialIntegrity():
            source, target = tables[cfg.table], tables[cfg.target_table]
            return Ask(
                cfg, (), checks.key_metrics(cfg), lambda rows: checks.referential_results(rows, source, target, cfg, as_of),
                {"n": 0, "nulls": 0},
            )
        case config.Cost():
            keys = (cfg.resource_column,) if cfg.resource_column else ()
            budgets = tables[cfg.budget_table] if cfg.budget_table else None
            return Ask(
                cfg, keys, checks.cost_metrics(cfg), lambda rows: checks.cost_results(rows, cfg, as_of, budgets), {"spent": 0.0}
            )
    return None


def _names(asks: Sequence[Ask]) -> list[dict[str, str]]:
    return [{name: f"_m{i}_{j}" for j, name in enumerate(ask.metrics)} for i, ask in enumerate(asks)]


def _columns(asks: Sequence[Ask]) -> list[str]:
    return sorted({k for ask in asks for k in ask.keys})


def shared(df: DataFrame, asks: Sequence[Ask]) -> DataFrame:
    """All aggregates of the asks, as one aggregation of ``df``."""
    exprs = [
        expr.alias(names[name]) for ask, names in zip(asks, _names(asks), strict=True) for name, expr in ask.metrics.items()
    ]
    sets = list(dict.fromkeys(tuple(sorted(ask.keys)) for ask in asks))
    columns = _columns(asks)
    if len(sets) == 1:
        return df.groupBy(*columns).agg(F.lit(0).cast("bigint").alias(_SET), *exprs)
    return df.groupingSets(sets, *columns).agg(F.grouping_id().alias(_SET), *exprs)


def answer(frame: DataFrame, asks: Sequence[Ask], ask: Ask) -> DataFrame:
    """The rows of one ask (its keys, then its metrics) from the shared frame of ``asks``."""
    columns = _columns(asks)
    several = len({tuple(sorted(a.keys)) for a in asks}) > 1
    number = sum(1 << k for k, c in enumerate(reversed(columns)) if c not in ask.keys) if several else 0
    names = _names(asks)[list(asks).index(ask)]
    rows = frame.where(F.col(_SET) == number).select(*ask.keys, *(F.col(own).alias(name) for name, own in names.items()))
    if ask.keys:
        return rows
    # grouping sets give no row for an empty table; an aggregate without keys has one
    one = lambda name: F.coalesce(F.first(name), F.lit(ask.empty[name])) if name in ask.empty else F.first(name)
    return rows.agg(*(one(name).alias(name) for name in ask.metrics))
