"""Running a suite: one shared scan for everything algebraic, one row per expectation.

Expectations fall into four classes. *Metadata* checks need only the schema. *Fused*
checks are aggregates folded into a single ``agg`` over the table. *Distinct* checks run
once per column on its value counts. *Distribution* checks (quantile, divergence) use the
order-statistics and histogram operators. All parts are unions of small result rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import as_double, is_numeric, ratio
from ..operators.histogram import kl_to_normal
from ..operators.local_rows import constant_rows, union_all
from ..operators.order_stats import nearest, select_ranks
from ..results import EXPECTATION_RESULTS
from . import expectations as E
from .isolate import settled
from .members import members_of

# Metrics per aggregate; wider aggregates outgrow generated code.
METRICS_PER_SCAN = 200

_NUMERIC = {
    E.BETWEEN, E.MEAN_BETWEEN, E.STDDEV_BETWEEN, E.MIN_BETWEEN, E.MAX_BETWEEN,
    E.KL_LESS_THAN, E.QUANTILE_BETWEEN,
}
_METADATA = {E.COLUMNS_ORDERED, E.COLUMN_TYPE, E.COLUMN_EXISTS}
_DISTINCT = {E.UNIQUE, E.DISTINCT_EQUAL_SET, E.DISTINCT_IN_SET}

ResultOf = Callable[[Callable[[str], Column]], dict[str, Column]]


@dataclass
class _Item:
    position: int
    expectation: E.Expectation


class _Metrics:
    """Aggregate expressions by name; equal names are computed once."""

    def __init__(self, df: DataFrame) -> None:
        self.exprs: dict[str, Column] = {}
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def need(self, name: str, expr: Column) -> str:
        self.exprs.setdefault(name, expr)
        return name


def _column_problem(df: DataFrame, e: E.Expectation) -> str | None:
    """Why the expectation cannot be planned, or None."""
    if e.column is not None and e.column not in df.columns and e.kind != E.COLUMN_EXISTS:
        return f"Column '{e.column}' not found"
    if e.kind in _NUMERIC and not is_numeric(df.schema[e.column].dataType):
        return f"Column '{e.column}' is not numeric"
    spark = df.sparkSession
    if e.kind in (E.MATCH_REGEX, E.NOT_MATCH_REGEX):
        try:  # folded at planning time, runs no job
            spark.sql("SELECT '' RLIKE :p AS ok", args={"p": e.params["pattern"]}).collect()
        except PySparkException:
            return f"Bad regex: {e.params['pattern']}"
    if e.kind == E.CUSTOM and e.params.get("expression"):
        try:
            dtype = df.select(F.expr(e.params["expression"]).alias("x")).schema["x"].dataType
        except PySparkException as err:
            return f"Bad expression: {str(err).splitlines()[0]}"
        if not isinstance(dtype, T.BooleanType):
            return f"Expression is not boolean: {e.params['expression']}"
    return None


def _json(**entries: Any) -> Column:
    """JSON text of literals and columns."""
    fields = [
        (v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in entries.items()
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _bound(x: float) -> float | None:
    return None if math.isinf(x) else x


def _in_range(v: Column, e: E.Expectation) -> Column:
    inside = F.lit(True)
    if not math.isinf(e.low):
        inside = inside & (v >= F.lit(e.low))
    if not math.isinf(e.high):
        inside = inside & (v <= F.lit(e.high))
    return F.coalesce(v.isNotNull() & inside, F.lit(False))


def _outside(v: Column, e: E.Expectation) -> Column:
    out = F.lit(False)
    if not math.isinf(e.low):
        out = out | (v < F.lit(e.low))
    if not math.isinf(e.high):
        out = out | (v > F.lit(e.high))
    return out


def _fused(e: E.Expectation, m: _Metrics) -> ResultOf:
    """Register the metrics of one expectation; return how to read its result row."""
    c = e.column
    col = F.col(f"`{c}`") if c else None
    rows = m.need("rows", F.count(F.lit(1)))
    limits = {"min": _bound(e.low), "max": _bound(e.high)}

    def row(success, observed, total, observed_json, expected_json, exception=None) -> dict[str, Column]:
        return {
            "success": success,
            "observed": observed.cast("double"),
            "total": total.cast("bigint"),
            "min_value": F.lit(limits["min"]).cast("double"),
            "max_value": F.lit(limits["max"]).cast("double"),
            "observed_json": observed_json,
            "expected_json": expected_json,
        }

    if e.kind == E.ROW_COUNT_BETWEEN:
        return lambda g: row(
            _in_range(g(rows), e), g(rows), g(rows), _json(row_count=g(rows)), _json(**limits)
        )

    if e.kind == E.NOT_NULL:
        nulls = m.need(f"nulls:{c}", F.count_if(col.isNull()))

        def result(g):
            allowed = F.floor(F.round(F.lit(float(e.tolerance)) * g(rows), 9)).cast("bigint")
            pct = ratio(g(nulls), g(rows), 0.0) * F.lit(100.0)
            return row(
                g(nulls) <= allowed, g(nulls), g(rows),
                _json(null_count=g(nulls), total=g(rows), null_pct=pct),
                _json(tolerance=float(e.tolerance), max_nulls=allowed),
            )

        return result

    if e.kind in (E.MATCH_REGEX, E.NOT_MATCH_REGEX):
        pattern = e.params["pattern"]
        wanted = e.kind == E.MATCH_REGEX
        hit = col.cast("string").rlike(pattern)
        bad = m.need(f"{e.kind}:{c}:{pattern}", F.count_if(~hit if wanted else hit))
        label = "mismatches" if wanted else "matches"
        return lambda g: row(
            g(bad) == 0, g(bad), g(rows),
            _json(**{label: g(bad), "total": g(rows)}), _json(pattern=pattern),
        )

    if e.kind == E.VALUES_IN_SET:
        values = e.values
        present = col.isNotNull()
        known = members_of(e.params["values"], m.types[c]).holds(col)
        bad = m.need(f"outside:{c}:{json.dumps(values)}", F.count_if(present & ~known))
        return lambda g: row(
            g(bad) == 0, g(bad), g(rows),
            _json(outside_set_count=g(bad)), _json(allowed_set=F.lit(values)),
        )

    if e.kind == E.CUSTOM:
        expression = e.params.get("expression")
        if not expression:
            return lambda g: row(
                F.lit(True), F.lit(None), g(rows),
                _json(note="no expression given, passes"), _json(type="custom", name=e.params["name"]),
            )
        bad = m.need(f"custom:{expression}", F.count_if(~F.expr(expression)))
        return lambda g: row(
            g(bad) == 0, g(bad), g(rows),
            _json(failed=g(bad), total=g(rows)),
            _json(type="custom", name=e.params["name"], expression=expression),
        )

    v = as_double(col)
    seen = m.need(f"count:{c}", F.count(v))
    if e.kind == E.BETWEEN:
        bad = m.need(f"between:{c}:{e.low}:{e.high}", F.count_if(_outside(v, e)))
        return lambda g: row(
            g(bad) == 0, g(bad), g(seen), _json(out_of_range=g(bad), total=g(seen)), _json(**limits)
        )

    label, expr = {
        E.MEAN_BETWEEN: ("mean", F.avg(v)),
        E.STDDEV_BETWEEN: ("stddev", F.stddev_samp(v)),
        E.MIN_BETWEEN: ("min", F.min(v)),
        E.MAX_BETWEEN: ("max", F.max(v)),
        E.QUANTILE_BETWEEN: (
            "quantile_value",
            F.percentile_approx(v, float(e.params.get("quantile", 0.5)), 10_000),
        ),
    }[e.kind]
    name = m.need(f"{label}:{c}:{e.params.get('quantile')}", expr)
    return lambda g: row(
        _in_range(g(name), e), g(name), g(seen),
        _json(**{label: g(name), "count": g(seen)}), _json(**limits),
    )


def _finish(base: DataFrame, suite: str, items: Sequence[tuple[_Item, dict[str, Column]]]) -> DataFrame:
    """Unpivot a one-row frame to one result row per expectation."""
    structs = []
    for item, got in items:
        e = item.expectation
        structs.append(
            F.struct(
                F.lit(suite).alias("suite"),
                F.lit(item.position).alias("position"),
                F.lit(e.kind).alias("expectation"),
                F.lit(e.column).cast("string").alias("column"),
                got["success"].alias("success"),
                got["observed"].alias("observed"),
                got["total"].alias("total"),
                got["min_value"].alias("min_value"),
                got["max_value"].alias("max_value"),
                got["observed_json"].alias("observed_json"),
                got["expected_json"].alias("expected_json"),
                F.lit(None).cast("string").alias("exception"),
            )
        )
    return base.select(F.inline(F.array(*structs)))


def _run_fused(df: DataFrame, suite: str, items: Sequence[_Item]) -> list[DataFrame]:
    parts: list[DataFrame] = []
    batch: list[tuple[_Item, ResultOf]] = []
    metrics = _Metrics(df)

    def flush() -> None:
        names = {key: f"m{i}" for i, key in enumerate(metrics.exprs)}
        wide = df.agg(*[expr.alias(names[key]) for key, expr in metrics.exprs.items()])
        read = lambda key: F.col(names[key])
        parts.append(_finish(wide, suite, [(item, result(read)) for item, result in batch]))

    for item in items:
        if len(metrics.exprs) >= METRICS_PER_SCAN:
            flush()
            batch, metrics = [], _Metrics(df)
        batch.append((item, _fused(item.expectation, metrics)))
    if batch:
        flush()
    return parts


def _can_fail(e: E.Expectation) -> bool:
    """Whether the user's own expression runs: it can divide by zero, overflow, or call a failing function."""
    return e.kind == E.CUSTOM and bool(e.params.get("expression"))


def _run_isolated(df: DataFrame, suite: str, items: Sequence[_Item]) -> tuple[list[DataFrame], list[tuple[_Item, str]]]:
    """The shared scan, run now; expressions that fail are found by halving and left out."""
    risky = [i for i in items if _can_fail(i.expectation)]
    safe = [i for i in items if not _can_fail(i.expectation)]
    scan = lambda some: union_all(_run_fused(df, suite, some))
    done, refused = settled([items], lambda all_: scan(all_[0]), "suite")
    if not refused:
        return [frame for frame, _ in done], []
    done, refused = settled(risky, scan, "suite")
    return _run_fused(df, suite, safe) + [frame for frame, _ in done], refused


def _run_distinct(df: DataFrame, suite: str, column: str, items: Sequence[_Item]) -> DataFrame:
    """All distinct-value checks of one column on one value count; null is one value."""
    counts = df.groupBy(F.col(f"`{column}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dtype = df.schema[column].dataType
    sets = {i.position: members_of(i.expectation.params["values"], dtype) for i in items if i.expectation.kind != E.UNIQUE}
    aggs = [
        F.count(F.lit(1)).alias("distinct"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("v").alias("known"),
    ]
    for position, members in sets.items():
        aggs.append(F.count_if(F.col("v").isNotNull() & members.holds(F.col("v"))).alias(f"in_{position}"))
    wide = counts.agg(*aggs)
    out = []
    for item in items:
        e = item.expectation
        distinct, total, known = F.col("distinct"), F.col("total"), F.col("known")
        if e.kind == E.UNIQUE:
            success, observed = distinct == total, total - distinct
            seen = _json(distinct=distinct, total=total, duplicates=observed)
            want = _json(distinct=total)
        else:
            inside = F.col(f"in_{item.position}")
            extra, missing = known - inside, F.lit(len(sets[item.position])) - inside
            if e.kind == E.DISTINCT_EQUAL_SET:
                success, observed = (extra == 0) & (missing == 0), extra + missing
                seen = _json(actual_distinct=known, missing=missing, extra=extra)
                want = _json(expected_set=F.lit(e.values))
            else:
                success, observed = extra == 0, extra
                seen = _json(actual_distinct=known, outside_set=extra)
                want = _json(allowed_set=F.lit(e.values))
        none = F.lit(None).cast("double")
        out.append((item, {
            "success": success, "observed": observed.cast("double"), "total": total,
            "min_value": none, "max_value": none, "observed_json": seen, "expected_json": want,
        }))
    return _finish(wide, suite, out)


def _run_large_set(df: DataFrame, suite: str, item: _Item) -> DataFrame:
    """A set check whose members are joined as a table: one scan, one row."""
    e = item.expectation
    members = members_of(e.params["values"], df.schema[e.column].dataType)
    value = F.col("v")
    known = members.table(df.sparkSession).withColumn("_known", F.lit(True))
    # members are distinct, so the join adds no rows
    wide = df.select(F.col(f"`{e.column}`").alias("v")).join(known, value == F.col("member"), "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(value.isNotNull() & F.col("_known").isNull()).alias("bad")
    )
    none = F.lit(None).cast("double")
    allowed = json.dumps({"allowed_set": e.values}, ensure_ascii=False, separators=(",", ":"))
    return _finish(wide, suite, [(item, {
        "success": F.col("bad") == 0, "observed": F.col("bad").cast("double"), "total": F.col("rows"),
        "min_value": none, "max_value": none,
        "observed_json": _json(outside_set_count=F.col("bad")), "expected_json": F.lit(allowed),
    })])


def _run_quantiles(df: DataFrame, suite: str, items: Sequence[_Item]) -> DataFrame:
    columns, wanted = {}, {}
    for item in items:
        e = item.expectation
        q = float(e.params["quantile"])
        columns[e.column] = as_double(F.col(f"`{e.column}`"))
        wanted.setdefault(e.column, {})[str(item.position)] = (q, nearest(q))
    found = select_ranks(df, columns, wanted)
    spec = constant_rows(
        df.sparkSession,
        "name STRING, position INT, column STRING, q DOUBLE, min_value DOUBLE, max_value DOUBLE",
        [
            (str(i.position), i.position, i.expectation.column, float(i.expectation.params["quantile"]),
             _bound(i.expectation.low), _bound(i.expectation.high))
            for i in items
        ],
    )
    v = F.col("value")
    ok = (
        v.isNotNull()
        & F.coalesce(v >= F.col("min_value"), F.lit(True))
        & F.coalesce(v <= F.col("max_value"), F.lit(True))
    )
    # Both sides have one row per quantile expectation.
    return found.join(F.broadcast(spec), "name").select(
        F.lit(suite).alias("suite"),
        "position",
        F.lit(E.QUANTILE_BETWEEN).alias("expectation"),
        "column",
        ok.alias("success"),
        v.alias("observed"),
        F.col("n").alias("total"),
        "min_value",
        "max_value",
        _json(quantile_value=v, quantile=F.col("q"), count=F.col("n")).alias("observed_json"),
        _json(quantile=F.col("q"), low=F.col("min_value"), high=F.col("max_value")).alias("expected_json"),
        F.lit(None).cast("string").alias("exception"),
    )


def _run_kl(df: DataFrame, suite: str, item: _Item) -> DataFrame:
    e = item.expectation
    kl, none = F.col("kl"), F.lit(None).cast("double")
    return _finish(
        kl_to_normal(df, e.column),
        suite,
        [(item, {
            "success": F.coalesce(kl <= F.lit(e.high), F.lit(False)),
            "observed": kl,
            "total": F.col("n"),
            "min_value": none,
            "max_value": F.lit(_bound(e.high)).cast("double"),
            "observed_json": _json(kl_divergence=kl, bins=F.col("bins")),
            "expected_json": _json(max_divergence=e.high),
        })],
    )


def _metadata_row(df: DataFrame, suite: str, item: _Item) -> tuple:
    e = item.expectation
    if e.kind == E.COLUMNS_ORDERED:
        actual, wanted = df.columns, list(e.params["columns"])
        success, seen, want = actual == wanted, {"actual_columns": actual}, {"expected_columns": wanted}
    elif e.kind == E.COLUMN_TYPE:
        actual, wanted = df.schema[e.column].dataType.simpleString(), e.params["type"]
        success, seen, want = actual == wanted, {"type": actual}, {"type": wanted}
    else:
        success = e.column in df.columns
        seen, want = {"exists": success}, {"exists": True}
    compact = {"separators": (",", ":")}
    return (suite, item.position, e.kind, e.column, success, None, None, None, None,
            json.dumps(seen, **compact), json.dumps(want, **compact), None)


def run_suite(suite: E.ExpectationSuite, df: DataFrame) -> DataFrame:
    """One result row per expectation, in the shape of ``results.EXPECTATION_RESULTS``.

    An expectation that cannot be planned (unknown column, wrong type, bad pattern) is a
    failed row with ``exception`` set; the others still run. The same holds for a custom
    expression that fails while it runs: a suite with custom expressions runs its shared
    scan now, and if it fails, again without those that fail.
    """
    spark: SparkSession = df.sparkSession
    constant: list[tuple] = []
    fused: list[_Item] = []
    distinct: dict[str, list[_Item]] = {}
    quantiles: list[_Item] = []
    divergences: list[_Item] = []
    large_sets: list[_Item] = []
    for position, e in enumerate(suite.expectations):
        item = _Item(position, e)
        problem = _column_problem(df, e)
        if problem:
            constant.append((suite.name, position, e.kind, e.column, False, None, None, None, None,
                             None, None, problem))
        elif e.kind in _METADATA:
            constant.append(_metadata_row(df, suite.name, item))
        elif e.kind in _DISTINCT:
            distinct.setdefault(e.column, []).append(item)
        elif e.kind == E.QUANTILE_BETWEEN and not e.params.get("approximate"):
            quantiles.append(item)
        elif e.kind == E.KL_LESS_THAN:
            divergences.append(item)
        elif e.kind == E.VALUES_IN_SET and members_of(e.params["values"], df.schema[e.column].dataType).joins():
            large_sets.append(item)
        else:
            fused.append(item)
    if any(_can_fail(item.expectation) for item in fused):
        parts, refused = _run_isolated(df, suite.name, fused)
        for item, problem in refused:
            e = item.expectation
            constant.append((suite.name, item.position, e.kind, e.column, False, None, None, None, None,
                             None, None, f"Failed while running: {problem}"))
    else:
        parts = _run_fused(df, suite.name, fused)
    parts += [_run_distinct(df, suite.name, c, items) for c, items in distinct.items()]
    if quantiles:
        parts.append(_run_quantiles(df, suite.name, quantiles))
    parts += [_run_kl(df, suite.name, item) for item in divergences]
    parts += [_run_large_set(df, suite.name, item) for item in large_sets]
    if constant or not parts:
        parts.append(constant_rows(spark, EXPECTATION_RESULTS, constant))
    return union_all(parts)


def summarize(results: DataFrame, suite: str | None = None) -> DataFrame:
    """Rows (suite, total, passed, failed, success_percent, success) of result rows.

    With ``suite`` an empty result still gives its one row (0 of 0, 100 percent).
    """
    counts = [
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("passed"),
    ]
    grouped = (
        results.agg(*counts).withColumn("suite", F.lit(suite))
        if suite is not None
        else results.groupBy("suite").agg(*counts)
    )
    total, passed = F.col("total"), F.col("passed")
    return grouped.select(
        "suite",
        "total",
        "passed",
        (total - passed).alias("failed"),
        (ratio(passed, total, 1.0) * F.lit(100.0)).alias("success_percent"),
        (total == passed).alias("success"),
    )


def failing_rows(df: DataFrame, e: E.Expectation) -> DataFrame:
    """The rows (or, for distinct checks, the values) behind a failed expectation."""
    col = F.col(f"`{e.column}`") if e.column else None
    text = col.cast("string") if e.column else None
    if e.kind == E.NOT_NULL:
        return df.where(col.isNull())
    if e.kind == E.BETWEEN:
        return df.where(_outside(as_double(col), e))
    if e.kind == E.MATCH_REGEX:
        return df.where(~text.rlike(e.params["pattern"]))
    if e.kind == E.NOT_MATCH_REGEX:
        return df.where(text.rlike(e.params["pattern"]))
    if e.kind == E.VALUES_IN_SET:
        return members_of(e.params["values"], df.schema[e.column].dataType).outside(df, col)
    if e.kind == E.CUSTOM and e.params.get("expression"):
        return df.where(~F.expr(e.params["expression"]))
    if e.kind == E.UNIQUE:
        return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    if e.kind in (E.DISTINCT_IN_SET, E.DISTINCT_EQUAL_SET):
        members = members_of(e.params["values"], df.schema[e.column].dataType)
        seen = df.where(col.isNotNull()).select(col.alias("v")).distinct()
        value = F.col("v").cast("string").alias("value")
        extra = seen.where(~members.holds(F.col("v"))).select(value, F.lit("extra").alias("side"))
        if e.kind == E.DISTINCT_IN_SET:
            return extra
        spark = df.sparkSession
        wanted = spark.range(1).select(F.explode(F.array(*members.literals()).cast(T.ArrayType(members.dtype))).alias("v"))
        missing = wanted.join(seen, "v", "left_anti").select(value, F.lit("missing").alias("side"))
        never = constant_rows(spark, "value STRING, side STRING", [(v, "missing") for v in members.absent])
        return extra.unionByName(missing).unionByName(never)
    raise ValueError(f"{e.kind} has no failing rows")
