"""Monitor configuration: plain values, one dataclass per monitor kind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ThresholdConfig:
    """How a limit is learned: method ``mad`` / ``sigma`` / ``iqr`` / ``fixed``."""

    method: str = "mad"
    sensitivity: float = 3.0
    min_threshold: float = 0.001
    max_threshold: float | None = None
    window_size: int = 20
    fixed: float | None = None


@dataclass(frozen=True)
class MonitorConfig:
    id: str
    table: str
    auto_threshold: bool = True
    threshold: ThresholdConfig = field(default_factory=ThresholdConfig)
    enabled: bool = True
    meta: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Freshness(MonitorConfig):
    ts_column: str = "ts"
    max_age_seconds: float = 3600.0
    by: Sequence[str] = ()


@dataclass(frozen=True)
class Volume(MonitorConfig):
    """Row count per time bucket. ``cold_start`` is ``quiet`` or ``reference``."""

    ts_column: str = "ts"
    bucket: str = "1 day"
    by: Sequence[str] = ()
    cold_start: str = "quiet"


@dataclass(frozen=True)
class Schema(MonitorConfig):
    pass


@dataclass(frozen=True)
class Distribution(MonitorConfig):
    """Drift of ``column`` by ``metric``: ``ks``, ``js``, ``chi_square`` or ``categorical``.

    ``reference`` and ``target`` are Boolean SQL conditions on the table; without a
    reference the target is compared with itself.
    """

    column: str = ""
    metric: str = "ks"
    reference: str | None = None
    target: str = "true"
    bins: int = 20


@dataclass(frozen=True)
class Correlation(MonitorConfig):
    column_x: str = ""
    column_y: str = ""
    method: str = "pearson"
    min_abs: float = 0.5


@dataclass(frozen=True)
class Uniqueness(MonitorConfig):
    columns: Sequence[str] = ()
    max_ratio: float = 0.0


@dataclass(frozen=True)
class ReferentialIntegrity(MonitorConfig):
    columns: Sequence[str] = ()
    target_table: str = ""
    target_columns: Sequence[str] = ()


@dataclass(frozen=True)
class CustomSql(MonitorConfig):
    """``query`` sees the tables as views; its first column of its first row is compared."""

    query: str = ""
    expected: float | None = None
    comparison: str = ">"


@dataclass(frozen=True)
class MlDrift(MonitorConfig):
    """``metric`` is ``prediction_drift``, ``feature_drift`` or ``accuracy_drop``."""

    model: str = ""
    metric: str = "prediction_drift"
    baseline: str = "false"
    current: str = "true"
    columns: Sequence[str] = ()
    label: str | None = None
    limit: float = 0.1
    statistic: str = "js"


@dataclass(frozen=True)
class Cost(MonitorConfig):
    """Sum of ``cost_column`` per resource against a budget (a value, or a table of budgets)."""

    resource: str = "query_cost"
    resource_column: str | None = None
    cost_column: str = "cost"
    budget: float | None = None
    budget_table: str | None = None
    budget_column: str = "budget"
