"""Schema, correlation, uniqueness, referential, custom SQL and cost monitors."""

from __future__ import annotations

import threading
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.numeric import ratio
from ...functions.timing import literal_instant
from ...functions.text import say
from ...operators.correlation import pair_metrics, pearson, spearman
from ...operators.distinct import duplicate_summary, orphan_keys
from ...operators.local_rows import constant_rows
from ...results import CRITICAL, INFO, details, monitor_results, severity_of
from .config import Correlation, Cost, CustomSql, ReferentialIntegrity, Schema, Uniqueness

Instant = datetime | str | Column

SNAPSHOT = "table_name STRING, ordinal INT, name STRING, dtype STRING, nullable BOOLEAN"
# Fixed value: fewest pairs a correlation is judged on.
MIN_PAIRS = 3
# Fixed value: tolerance of an equality comparison.
EQUAL_TOLERANCE = 1e-6


def schema_snapshot(df: DataFrame, table: str) -> DataFrame:
    """Rows (table_name, ordinal, name, dtype, nullable) of a table, without a scan."""
    return constant_rows(
        df.sparkSession,
        SNAPSHOT,
        [(table, i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)],
    )


def schema_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (table_name, change, o1, o2): ``+col (t)``, ``~col: a -> b``, ``-col (t)``.

    Snapshots may hold many tables; they are matched by table and column name.
    """
    b = before.select("table_name", "name", F.col("ordinal").alias("bo"), F.col("dtype").alias("bt"))
    a = after.select("table_name", "name", F.col("ordinal").alias("ao"), F.col("dtype").alias("at"))
    both = b.join(a, ["table_name", "name"], "full_outer")
    change = (
        F.when(F.col("bt").isNull(), say("+%s (%s)", "name", "at"))
        .when(F.col("at").isNull(), say("-%s (%s)", "name", "bt"))
        .when(F.col("at") != F.col("bt"), say("~%s: %s -> %s", "name", "bt", "at"))
    )
    return both.select(
        "table_name",
        change.alias("change"),
        F.when(F.col("at").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("o1"),
        F.coalesce("ao", "bo").alias("o2"),
    ).where("change IS NOT NULL")


def check_schema(
    cfg: Schema, current: DataFrame, last: DataFrame | None, as_of: Instant
) -> DataFrame:
    """Difference of two snapshots; without an earlier one there is nothing to report."""
    now, table = literal_instant(as_of), F.lit(cfg.table)
    changes = schema_changes(current if last is None else last, current)
    # A table's changes are at most its columns.
    grouped = changes.where(F.col("table_name") == table).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("o1", "o2", "change"))), lambda x: x["change"]
        ).alias("changes")
    )
    listed, n = F.col("changes"), F.size("changes")
    alert = n > 0
    starts = lambda sign: F.to_json(F.filter(listed, lambda c: c.startswith(sign)))
    when_any = lambda c: F.when(alert, c)
    return monitor_results(
        grouped,
        monitor_id=F.lit(cfg.id),
        monitor_type="schema",
        table_name=cfg.table,
        alert=alert,
        severity=severity_of(alert, F.lit(False)),
        score=n,
        threshold=F.lit(0.0),
        message=F.when(
            alert,
            say(
                "Schema alert: table '%s' schema changed — [%s]", table, F.array_join(listed, ", ")
            ),
        ).otherwise(say("Schema OK: table '%s' schema unchanged", table)),
        details=details(
            changes=F.to_json(listed),
            added_columns=when_any(starts("+")),
            removed_columns=when_any(starts("-")),
            changed_columns=when_any(starts("~")),
        ),
        ts=now,
    )


def check_correlation(df: DataFrame, cfg: Correlation, as_of: Instant) -> DataFrame:
    """Alert when the correlation of two columns is weaker than expected."""
    measure = {"pearson": pearson, "spearman": spearman}[cfg.method]
    return correlation_results(measure(df, cfg.column_x, cfg.column_y), cfg, as_of)


def pearson_metrics(cfg: Correlation) -> dict[str, Column]:
    return pair_metrics(cfg.column_x, cfg.column_y)


def correlation_results(rows: DataFrame, cfg: Correlation, as_of: Instant) -> DataFrame:
    """Results from one row (correlation, n)."""
    r, n, limit = F.col("correlation"), F.col("n"), F.lit(float(cfg.min_abs))
    enough = n >= MIN_PAIRS
    alert = F.coalesce(enough & (F.abs(r) < F.abs(limit)), F.lit(False))
    method = F.lit(cfg.method)
    return monitor_results(
        rows,
        monitor_id=F.lit(cfg.id),
        monitor_type="correlation",
        table_name=cfg.table,
        alert=alert,
        severity=severity_of(alert, F.lit(False)),
        score=F.when(enough, r),
        threshold=limit,
        message=F.when(~enough, F.lit("Correlation unknown: fewer than 3 pairs"))
        .when(alert, say("Correlation alert: %s=%.4f below threshold %.4f", method, r, limit))
        .otherwise(say("Correlation OK: %s=%.4f", method, r)),
        details=details(
            correlation=r,
            threshold=limit,
            method=method,
            n=n,
            column_x=F.lit(cfg.column_x),
            column_y=F.lit(cfg.column_y),
        ),
        ts=literal_instant(as_of),
    )


def check_uniqueness(df: DataFrame, cfg: Uniqueness, as_of: Instant) -> DataFrame:
    """Share of rows that repeat a (composite) key."""
    rows = duplicate_summary(df, list(cfg.columns))
    share, limit = F.col("duplicate_ratio"), F.lit(float(cfg.max_ratio))
    alert = share > limit
    return monitor_results(
        rows,
        monitor_id=F.lit(cfg.id),
        monitor_type="uniqueness",
        table_name=cfg.table,
        alert=alert,
        severity=severity_of(alert, F.lit(False)),
        score=share,
        threshold=limit,
        message=F.when(
            alert,
            say(
                "Uniqueness alert: %.1f%% duplicates (threshold: %.1f%%)", share * 100.0, limit * 100.0
            ),
        ).otherwise(say("Uniqueness OK: %.1f%% duplicates", share * 100.0)),
        details=details(
            total_rows=F.col("total_rows"),
            unique_values=F.col("unique_values"),
            duplicate_count=F.col("duplicate_count"),
            duplicate_ratio=share,
            threshold_ratio=limit,
        ),
        ts=literal_instant(as_of),
    )


def check_referential(
    source: DataFrame, target: DataFrame, cfg: ReferentialIntegrity, as_of: Instant
) -> DataFrame:
    """Source rows whose key is missing from the target. Null keys are counted apart."""
    return referential_results(source.agg(*(e.alias(k) for k, e in key_metrics(cfg).items())), source, target, cfg, as_of)


def key_metrics(cfg: ReferentialIntegrity) -> dict[str, Column]:
    has_null = F.lit(False)
    for c in cfg.columns:
        has_null = has_null | F.col(c).isNull()
    return {"n": F.count(F.lit(1)), "nulls": F.count_if(has_null)}


def referential_results(
    counted: DataFrame, source: DataFrame, target: DataFrame, cfg: ReferentialIntegrity, as_of: Instant
) -> DataFrame:
    """Results from one row (n, nulls) of the source, and the keys of both tables."""
    keys = list(cfg.columns)
    orphans = orphan_keys(source, keys, target, list(cfg.target_columns or keys))
    totals = counted.select(F.struct("n", "nulls").alias("t")).scalar()
    rows = orphans.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphans")).select(
        "orphans",
        totals["n"].alias("n"),
        totals["nulls"].alias("nulls"),
        ratio(F.col("orphans"), totals["n"], 0.0).alias("share"),
    )
    found, alert = F.col("orphans"), F.col("orphans") > 0
    return monitor_results(
        rows,
        monitor_id=F.lit(cfg.id),
        monitor_type="referential",
        table_name=cfg.table,
        alert=alert,
        severity=F.when(alert, F.lit(CRITICAL)).otherwise(F.lit(INFO)),
        score=found,
        threshold=F.lit(0.0),
        message=F.when(
            alert,
            say(
                "Referential integrity alert: %d orphan rows (%.1f%%)", found, F.col("share") * 100.0
            ),
        ).otherwise(F.lit("Referential integrity OK: no orphan rows")),
        details=details(
            total_rows=F.col("n"), orphan_count=found, orphan_ratio=F.col("share"), null_keys=F.col("nulls")
        ),
        ts=literal_instant(as_of),
    )


_VIEW_NAMES = threading.Lock()  # monitors run side by side and share the names


def _answer(tables: Mapping[str, DataFrame], query: str) -> DataFrame:
    """The query over the tables by name. Views of the caller with these names are put back."""
    with _VIEW_NAMES:
        return _read_views(tables, query)


def _read_views(tables: Mapping[str, DataFrame], query: str) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    own = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name in own}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(query)
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def check_custom_sql(tables: Mapping[str, DataFrame], cfg: CustomSql, as_of: Instant) -> DataFrame:
    """Compare the single value of a query with an expected one.

    A query that answers with no row or with several is a failed check, never cut to one row.
    """
    answer = _answer(tables, cfg.query)
    rows = answer.select(answer[answer.columns[0]].cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("answers"), F.max("value").alias("value")
    )
    single = F.col("answers") == 1
    rows = rows.withColumn("observed", F.when(single, F.col("value")))
    observed = F.col("observed")
    expected = F.lit(cfg.expected).cast("double")
    off = {
        ">": observed > expected,
        "<": observed < expected,
        "=": F.abs(observed - expected) > EQUAL_TOLERANCE,
    }[cfg.comparison]
    alert = ~single | F.coalesce(off, F.lit(False))
    op = F.lit(cfg.comparison)
    return monitor_results(
        rows,
        monitor_id=F.lit(cfg.id),
        monitor_type="custom_sql",
        table_name=cfg.table,
        alert=alert,
        severity=severity_of(alert, F.lit(False)),
        score=observed,
        threshold=F.coalesce(expected, F.lit(0.0)),
        message=F.when(~single, say("Custom SQL alert: the query gave %d rows, one is expected", F.col("answers")))
        .when(alert, say("Custom SQL alert: observed=%.4f %s expected=%.4f", observed, op, expected))
        .otherwise(say("Custom SQL OK: observed=%.4f", observed)),
        details=details(observed=observed, expected=expected, comparison=op),
        ts=literal_instant(as_of),
    )


def check_cost(
    usage: DataFrame, cfg: Cost, as_of: Instant, budgets: DataFrame | None = None
) -> DataFrame:
    """Cost per resource against its budget.

    Usage is summed per resource first; ``budgets`` has the resource column and a budget,
    else the one budget of the configuration holds for every resource. A resource without
    a budget is reported as such.
    """
    keys = [cfg.resource_column] if cfg.resource_column else []
    return cost_results(usage.groupBy(*keys).agg(*(e.alias(k) for k, e in cost_metrics(cfg).items())), cfg, as_of, budgets)


def cost_metrics(cfg: Cost) -> dict[str, Column]:
    return {"spent": F.coalesce(F.sum(cfg.cost_column), F.lit(0.0)).cast("double")}


def cost_results(spent: DataFrame, cfg: Cost, as_of: Instant, budgets: DataFrame | None = None) -> DataFrame:
    """Results from rows (resource, spent)."""
    keys = [cfg.resource_column] if cfg.resource_column else []
    if budgets is not None:
        spent = spent.join(
            budgets.select(*keys, F.col(cfg.budget_column).cast("double").alias("budget")), keys, "left"
        )
    else:
        spent = spent.withColumn("budget", F.lit(cfg.budget).cast("double"))
    cost, budget = F.col("spent"), F.col("budget")
    rows = spent.withColumn("times", F.when(budget > 0, ratio(cost, budget)).otherwise(F.lit(1.0)))
    alert, times = F.coalesce(cost > budget, F.lit(False)), F.col("times")
    resource = F.lit(cfg.resource)
    monitor_id = F.lit(cfg.id)
    if keys:
        monitor_id = F.concat_ws(":", monitor_id, F.col(keys[0]).cast("string"))
    return monitor_results(
        rows,
        monitor_id=monitor_id,
        monitor_type="cost",
        table_name=cfg.table,
        alert=alert,
        severity=severity_of(alert, times > 2.0),
        score=cost,
        threshold=budget,
        message=F.when(
            alert,
            say(
                "Cost alert: %s cost=%.2f exceeds budget=%.2f (x%.1f)", resource, cost, budget, times
            ),
        )
        .when(budget.isNull(), say("Cost: %s cost=%.2f has no budget", resource, cost))
        .otherwise(say("Cost OK: %s cost=%.2f within budget=%.2f", resource, cost, budget)),
        details=details(current_cost=cost, budget=budget, ratio=times, resource_type=resource),
        ts=literal_instant(as_of),
    )
