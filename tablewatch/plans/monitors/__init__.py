"""Monitors: each turns a table into rows of ``results.MONITOR_RESULTS``."""

from .checks import (
    check_correlation,
    check_cost,
    check_custom_sql,
    check_referential,
    check_schema,
    check_uniqueness,
    schema_snapshot,
)
from .config import (
    Correlation,
    Cost,
    CustomSql,
    Distribution,
    Freshness,
    MlDrift,
    MonitorConfig,
    ReferentialIntegrity,
    Schema,
    ThresholdConfig,
    Uniqueness,
    Volume,
)
from .drift import against_summary, capture_reference, check_distribution, check_ml_drift, drift_series
from .run import run_monitors
from .table_metrics import check_freshness, check_volume, volume_timeline

__all__ = [
    "Correlation", "Cost", "CustomSql", "Distribution", "Freshness", "MlDrift", "MonitorConfig",
    "ReferentialIntegrity", "Schema", "ThresholdConfig", "Uniqueness", "Volume",
    "against_summary", "capture_reference", "check_correlation", "check_cost", "check_custom_sql",
    "check_distribution", "check_freshness", "check_ml_drift", "check_referential", "check_schema",
    "check_uniqueness", "check_volume", "drift_series", "run_monitors", "schema_snapshot",
    "volume_timeline",
]
