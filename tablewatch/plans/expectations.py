"""Declarative expectations and suites. Values here are plain configuration."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

# Names of the expectation kinds.
NOT_NULL = "not_null"
UNIQUE = "unique"
BETWEEN = "between"
ROW_COUNT_BETWEEN = "row_count_between"
MEAN_BETWEEN = "column_mean_between"
STDDEV_BETWEEN = "column_stddev_between"
MIN_BETWEEN = "column_min_between"
MAX_BETWEEN = "column_max_between"
MATCH_REGEX = "match_regex"
NOT_MATCH_REGEX = "not_match_regex"
DISTINCT_EQUAL_SET = "distinct_values_equal_set"
DISTINCT_IN_SET = "distinct_values_contained_in_set"
VALUES_IN_SET = "column_values_to_be_in_set"
KL_LESS_THAN = "column_kl_divergence_less_than"
QUANTILE_BETWEEN = "column_quantile_between"
COLUMNS_ORDERED = "table_columns_match_ordered_list"
CUSTOM = "custom"
COLUMN_TYPE = "column_type"
COLUMN_EXISTS = "column_exists"


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)
    tolerance: float = 0.0
    meta: Mapping[str, str] = field(default_factory=dict)

    def with_meta(self, **labels: str) -> Expectation:
        return replace(self, meta={**self.meta, **labels})

    @property
    def low(self) -> float:
        return float(self.params.get("min", -math.inf))

    @property
    def high(self) -> float:
        return float(self.params.get("max", math.inf))

    @property
    def values(self) -> list[str]:
        """Members as they are shown; ``members_of`` gives them the column's type."""
        return list(dict.fromkeys(str(v) for v in self.params["values"]))


@dataclass
class ExpectationSuite:
    name: str
    expectations: list[Expectation] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)

    def add(self, *expectations: Expectation) -> ExpectationSuite:
        self.expectations.extend(expectations)
        return self

    def with_meta(self, **labels: str) -> ExpectationSuite:
        self.meta.update(labels)
        return self

    def __len__(self) -> int:
        return len(self.expectations)


def _ranged(kind: str, column: str | None, low: float | None, high: float | None, **more) -> Expectation:
    params = dict(more)
    if low is not None:
        params["min"] = low
    if high is not None:
        params["max"] = high
    return Expectation(kind, column, params)


def not_null(column: str, tolerance: float = 0.0) -> Expectation:
    """At most floor(tolerance * rows) nulls."""
    return Expectation(NOT_NULL, column, tolerance=tolerance)


def unique(column: str) -> Expectation:
    return Expectation(UNIQUE, column)


def between(column: str, low: float | None, high: float | None) -> Expectation:
    return _ranged(BETWEEN, column, low, high)


def row_count_between(low: int | None, high: int | None) -> Expectation:
    return _ranged(ROW_COUNT_BETWEEN, None, low, high)


def mean_between(column: str, low: float | None, high: float | None) -> Expectation:
    return _ranged(MEAN_BETWEEN, column, low, high)


def stddev_between(column: str, low: float | None, high: float | None) -> Expectation:
    return _ranged(STDDEV_BETWEEN, column, low, high)


def min_between(column: str, low: float | None, high: float | None) -> Expectation:
    return _ranged(MIN_BETWEEN, column, low, high)


def max_between(column: str, low: float | None, high: float | None) -> Expectation:
    return _ranged(MAX_BETWEEN, column, low, high)


def match_regex(column: str, pattern: str) -> Expectation:
    """Every non-null value contains a match (unanchored search)."""
    return Expectation(MATCH_REGEX, column, {"pattern": pattern})


def not_match_regex(column: str, pattern: str) -> Expectation:
    return Expectation(NOT_MATCH_REGEX, column, {"pattern": pattern})


def distinct_equal_set(column: str, values: Sequence[Any]) -> Expectation:
    return Expectation(DISTINCT_EQUAL_SET, column, {"values": list(values)})


def distinct_in_set(column: str, values: Sequence[Any]) -> Expectation:
    return Expectation(DISTINCT_IN_SET, column, {"values": list(values)})


def values_in_set(column: str, values: Sequence[Any]) -> Expectation:
    return Expectation(VALUES_IN_SET, column, {"values": list(values)})


def kl_less_than(column: str, max_divergence: float) -> Expectation:
    return Expectation(KL_LESS_THAN, column, {"max": max_divergence})


def quantile_between(
    column: str, q: float, low: float | None, high: float | None, approximate: bool = False
) -> Expectation:
    """Nearest-rank quantile within bounds; ``approximate`` takes it from a sketch."""
    return _ranged(QUANTILE_BETWEEN, column, low, high, quantile=q, approximate=approximate)


def columns_match(columns: Sequence[str]) -> Expectation:
    return Expectation(COLUMNS_ORDERED, None, {"columns": list(columns)})


def custom(name: str, expression: str | None = None, **config: Any) -> Expectation:
    """A Boolean Spark SQL expression no row may fail; without one it always passes."""
    return Expectation(CUSTOM, None, {"name": name, "expression": expression, **config})


def column_type(column: str, dtype: str) -> Expectation:
    return Expectation(COLUMN_TYPE, column, {"type": dtype})


def column_exists(column: str) -> Expectation:
    return Expectation(COLUMN_EXISTS, column)
