"""Expectation suggestions from column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from ..functions.text import say
from . import expectations as E

# Fixed value: most distinct values for which a set is suggested.
SET_LIMIT = 20


def small_domains(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column_name, values) of columns known to hold few distinct values: one scan for all of them."""
    sets = [F.array_sort(F.collect_set(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.transform(f"s{i}", lambda x: x.cast("string")).alias("values"))
        for i, c in enumerate(columns)
    ]
    return df.agg(*sets).select(F.inline(F.array(*rows)))


def _suggestion(
    when: Column, kind: str, confidence: Column, reason: Column,
    low: Column | None = None, high: Column | None = None, values: Column | None = None,
) -> Column:
    none = F.lit(None).cast("double")
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("expectation"),
            (none if low is None else low).alias("min_value"),
            (none if high is None else high).alias("max_value"),
            (F.lit(None).cast("array<string>") if values is None else values).alias("values"),
            confidence.cast("double").alias("confidence"),
            reason.alias("reason"),
        ),
    )


def suggest(
    profiles: DataFrame, df: DataFrame | None = None, include_strings: bool = False
) -> DataFrame:
    """Rows (table_name, column_name, expectation, min_value, max_value, values, confidence, reason).

    With ``df`` (the profiled table) set suggestions carry the observed values; numeric
    columns only unless ``include_strings``.
    """
    # A profile has one row per column; it is read once, as it names the columns worth a second scan.
    known = profiles.collect()
    p = profiles.sparkSession.createDataFrame(known, profiles.schema)
    few = [
        r["column_name"] for r in known
        if df is not None and 0 < r["distinct_count"] <= SET_LIMIT and r["null_count"] == 0
        and (r["min_val"] is not None or (include_strings and r["dtype"] == "string"))
    ]
    if few:
        # At most one row per column, each with at most SET_LIMIT values.
        p = p.join(F.broadcast(small_domains(df, few)), "column_name", "left")
    else:
        p = p.withColumn("values", F.lit(None).cast("array<string>"))
    rows, nulls, distinct = F.col("row_count"), F.col("null_count"), F.col("distinct_count")
    low, high, mean = F.col("min_val"), F.col("max_val"), F.col("mean_val")
    null_share = ratio(nulls, F.greatest(rows, F.lit(1)), 0.0)
    q1, q3 = F.get("quantiles", F.lit(1)), F.get("quantiles", F.lit(3))
    iqr = q3 - q1
    numeric = low.isNotNull() & high.isNotNull()
    domain_gate = F.lit(True) if include_strings else numeric
    candidates = [
        _suggestion(
            (nulls > 0) & (null_share < 0.05),
            E.NOT_NULL,
            F.lit(0.9) - F.least(null_share * 5.0, F.lit(0.8)),
            say("%.1f%% null values — consider not_null expectation", null_share * 100.0),
        ),
        _suggestion(
            (distinct == rows) & (rows > 1),
            E.UNIQUE,
            F.lit(0.8),
            say("All %d values are unique — consider unique expectation", rows),
        ),
        _suggestion(
            numeric & (high > low),
            E.BETWEEN,
            F.lit(0.6),
            say("Values range [%.2f, %.2f] — consider between expectation", low, high),
            low,
            high,
        ),
        _suggestion(
            numeric & (iqr > 0),
            E.BETWEEN,
            F.lit(0.5),
            say(
                "IQR-based bounds [%.2f, %.2f] — consider between expectation",
                q1 - F.lit(1.5) * iqr,
                q3 + F.lit(1.5) * iqr,
            ),
            q1 - F.lit(1.5) * iqr,
            q3 + F.lit(1.5) * iqr,
        ),
        _suggestion(
            numeric & mean.isNotNull(),
            E.MEAN_BETWEEN,
            F.lit(0.4),
            say("Mean is %.2f — consider column_mean_between(mean*0.8, mean*1.2)", mean),
            F.least(mean * 0.8, mean * 1.2),
            F.greatest(mean * 0.8, mean * 1.2),
        ),
        _suggestion(
            (nulls == 0) & (distinct > 0) & (distinct <= SET_LIMIT) & domain_gate,
            E.VALUES_IN_SET,
            F.lit(0.3),
            say("Only %d distinct values — consider values_in_set expectation", distinct),
            values=F.col("values"),
        ),
    ]
    found = F.filter(F.array(*candidates), lambda s: s.isNotNull())
    return p.select("table_name", "column_name", F.inline(found))


def to_suite(name: str, suggestions: DataFrame, min_confidence: float = 0.0) -> E.ExpectationSuite:
    """A runnable suite; reads the suggestion rows (at most six per column) to the driver."""
    suite = E.ExpectationSuite(name)
    for row in suggestions.where(F.col("confidence") >= min_confidence).collect():
        params = {}
        if row["min_value"] is not None:
            params = {"min": row["min_value"], "max": row["max_value"]}
        if row["expectation"] == E.VALUES_IN_SET:
            if row["values"] is None:
                continue
            params = {"values": list(row["values"])}
        tolerance = 0.05 if row["expectation"] == E.NOT_NULL else 0.0
        suite.add(E.Expectation(row["expectation"], row["column_name"], params, tolerance))
    return suite
