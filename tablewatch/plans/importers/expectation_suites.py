"""Suite documents in the Great Expectations JSON format, as expectation rows and suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import expectations as E

# Fixed value: the document fields that are read.
DOCUMENT = """
expectation_suite_name STRING,
expectations ARRAY<STRUCT<
  expectation_type STRING,
  kwargs STRUCT<
    column STRING, value STRING, regex STRING, type_ STRING, min_value DOUBLE, max_value DOUBLE,
    mostly DOUBLE, value_set ARRAY<STRING>, threshold DOUBLE, column_list ARRAY<STRING>>>>
"""

# Document names of the expectations that are understood.
NAMES = {
    "expect_column_to_exist": E.COLUMN_EXISTS,
    "expect_table_row_count_to_be_between": E.ROW_COUNT_BETWEEN,
    "expect_column_values_to_not_be_null": E.NOT_NULL,
    "expect_column_values_to_be_unique": E.UNIQUE,
    "expect_column_values_to_be_in_set": E.VALUES_IN_SET,
    "expect_column_values_to_not_be_in_set": E.CUSTOM,
    "expect_column_distinct_values_to_equal_set": E.DISTINCT_EQUAL_SET,
    "expect_column_distinct_values_to_be_contained_in_set": E.DISTINCT_IN_SET,
    "expect_column_values_to_be_between": E.BETWEEN,
    "expect_column_min_to_be_between": E.MIN_BETWEEN,
    "expect_column_max_to_be_between": E.MAX_BETWEEN,
    "expect_column_mean_to_be_between": E.MEAN_BETWEEN,
    "expect_column_quantile_values_to_be_between": E.QUANTILE_BETWEEN,
    "expect_column_stdev_to_be_between": E.STDDEV_BETWEEN,
    "expect_column_kl_divergence_to_be_less_than": E.KL_LESS_THAN,
    "expect_column_values_to_match_regex": E.MATCH_REGEX,
    "expect_column_values_to_not_match_regex": E.NOT_MATCH_REGEX,
    "expect_table_columns_to_match_set": E.COLUMNS_ORDERED,
    "expect_column_values_to_be_of_type": E.COLUMN_TYPE,
}
DEFAULT_KL = 0.1
DEFAULT_QUANTILE = 0.5

_SETS = {E.VALUES_IN_SET, E.DISTINCT_EQUAL_SET, E.DISTINCT_IN_SET}
_PATTERNS = {E.MATCH_REGEX, E.NOT_MATCH_REGEX}


def _quoted(values: Column) -> Column:
    one = lambda v: F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.array_join(F.transform(values, one), ", ")


def translate(documents: DataFrame, text: str = "document") -> DataFrame:
    """Rows (suite, position, expectation, column, min_value, max_value, quantile, values,
    pattern, expression, dtype, tolerance); unknown names are skipped."""
    doc = documents.select(F.from_json(F.col(text), DOCUMENT).alias("d"))
    rows = doc.select(
        F.coalesce("d.expectation_suite_name", F.lit("")).alias("suite"),
        F.posexplode("d.expectations").alias("position", "e"),
    )
    kw = F.col("e.kwargs")
    pairs = [x for name, kind in NAMES.items() for x in (F.lit(name), F.lit(kind))]
    kind = F.try_element_at(F.create_map(*pairs), F.col("e.expectation_type"))
    rows = rows.withColumn("expectation", kind).where("expectation IS NOT NULL")
    name = F.col("e.expectation_type")
    is_kl, is_q = F.col("expectation") == E.KL_LESS_THAN, F.col("expectation") == E.QUANTILE_BETWEEN
    excluded = F.coalesce(kw["value_set"], F.array().cast("array<string>"))
    expression = F.when(
        F.size(excluded) > 0,
        F.concat(F.lit("CAST(`"), kw["column"], F.lit("` AS STRING) NOT IN ("), _quoted(excluded), F.lit(")")),
    )
    return rows.select(
        "suite",
        "position",
        "expectation",
        kw["column"].alias("column"),
        F.when(~is_kl, kw["min_value"]).alias("min_value"),
        F.when(is_kl, F.coalesce(kw["threshold"], F.lit(DEFAULT_KL))).otherwise(kw["max_value"]).alias("max_value"),
        F.when(is_q, F.lit(DEFAULT_QUANTILE)).alias("quantile"),
        F.when(F.col("expectation").isin(list(_SETS)), kw["value_set"])
        .when(F.col("expectation") == E.COLUMNS_ORDERED, kw["column_list"])
        .alias("values"),
        F.when(F.col("expectation").isin(list(_PATTERNS)), F.coalesce(kw["regex"], kw["value"], F.lit(""))).alias(
            "pattern"
        ),
        F.when(name == "expect_column_values_to_not_be_in_set", expression).alias("expression"),
        F.when(
            F.col("expectation") == E.COLUMN_TYPE, F.coalesce(kw["type_"], kw["value"], F.lit("unknown"))
        ).alias("dtype"),
        F.when(
            F.col("expectation") == E.NOT_NULL, F.round(F.lit(1.0) - F.coalesce(kw["mostly"], F.lit(1.0)), 9)
        )
        .otherwise(F.lit(0.0))
        .alias("tolerance"),
    )


def to_suite(translated: DataFrame, name: str) -> E.ExpectationSuite:
    """One runnable suite: only its rows are read to the driver. A suite without rows is empty."""
    return to_suites(translated.where(F.col("suite") == name)).get(name, E.ExpectationSuite(name))


def to_suites(translated: DataFrame) -> dict[str, E.ExpectationSuite]:
    """Runnable suites of few documents: all rows are read to the driver. Of many, take one at a time with ``to_suite``."""
    suites: dict[str, E.ExpectationSuite] = {}
    for r in translated.orderBy("suite", "position").collect():
        params = {}
        if r["min_value"] is not None:
            params["min"] = r["min_value"]
        if r["max_value"] is not None:
            params["max"] = r["max_value"]
        kind = r["expectation"]
        if kind in _SETS:
            params["values"] = list(r["values"] or [])
        elif kind == E.COLUMNS_ORDERED:
            params["columns"] = list(r["values"] or [])
        elif kind in _PATTERNS:
            params["pattern"] = r["pattern"]
        elif kind == E.CUSTOM:
            params |= {"name": "not_in_set", "expression": r["expression"]}
        elif kind == E.COLUMN_TYPE:
            params["type"] = r["dtype"]
        elif kind == E.QUANTILE_BETWEEN:
            params["quantile"] = r["quantile"]
        suite = suites.setdefault(r["suite"], E.ExpectationSuite(r["suite"]))
        suite.add(E.Expectation(kind, r["column"], params, r["tolerance"]))
    return suites
