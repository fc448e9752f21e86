"""Table and column lineage from a table of SQL statements.

Statements are read in Arrow batches, token by token with a stack of query scopes (``statement_scopes``); what follows from
them, edges and neighbours, is joins and groups. What creates, inserts into or merges into a table has a target; what FROM,
JOIN or MERGE's USING name are sources. Names of CTEs and aliases of subqueries are no tables: their columns are followed to
the tables behind them. Comments and literals give neither tables nor columns. An unreadable text has no target, and the
sources that were read.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .statement_scopes import ByTemplate, mappings_of, tables_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TABLES = T.StructType().add("target_table", "string").add("source_tables", T.ArrayType(T.StringType()))
_MAPPINGS = T.StructType().add("position", "integer")
for _name in ("target_column", "source_table", "source_column", "expression"):
    _MAPPINGS.add(_name, "string")


def _read(queries: DataFrame, sql: str, found: T.StructType, rows_of: Callable[[str], list[tuple]]) -> DataFrame:
    """``queries`` with the columns of ``found``, one row for each tuple that a statement gives."""
    added = set(found.names)
    plain = queries.select(*(c for c in queries.columns if c not in added))
    kinds = [pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.int32() if f.dataType == T.IntegerType() else pa.string() for f in found.fields]
    names = found.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ByTemplate(rows_of)
        for batch in batches:
            own = [read(text or "") for text in batch.column(sql).to_pylist()]
            at = pa.array(chain.from_iterable([k] * len(rows) for k, rows in enumerate(own)), pa.int64())
            columns = list(zip(*chain.from_iterable(own), strict=True)) or [()] * len(names)
            kept = batch.take(at)
            yield pa.record_batch(
                [*kept.columns, *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *names]
            )

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *found.fields]))


def statements(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """Add ``target_table`` and ``source_tables`` (in order, without repeats) to query rows."""
    return _read(queries, sql, _TABLES, lambda text: [tables_of(text)])


def column_mappings(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """One row per selected column and column it is made of: input columns plus (position, target_column,
    source_table, source_column, expression).

    Aliases are replaced by their tables, columns of CTEs and subqueries by the columns behind them; branches of a set
    operation share the positions and names of the first. ``*`` is left out; a source without a qualifier has no table,
    unless it is in a CTE or subquery over one table; and an expression of no column has no source.
    """
    return _read(queries, sql, _MAPPINGS, mappings_of)


def edges(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """Distinct rows (source_table, target_table)."""
    parsed = statements(queries, sql).where("target_table IS NOT NULL")
    return parsed.select(F.explode("source_tables").alias("source_table"), "target_table").distinct()


def column_edges(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """Distinct rows (target_table, target_column, source_table, source_column, transformation)."""
    found = T.StructType([_TABLES[0], *_MAPPINGS.fields[1:]])
    parsed = _read(queries.select(sql), sql, found, lambda text: [(tables_of(text)[0], *row[1:]) for row in mappings_of(text)])
    return (
        parsed.where("target_table IS NOT NULL AND source_table IS NOT NULL")
        .select("target_table", "target_column", "source_table", "source_column", F.col("expression").alias("transformation"))
        .distinct()
    )


def _links(queries: DataFrame, sql: str) -> DataFrame:
    """Distinct rows (table, direction, neighbour): both directions of every edge, and every table on its own with nulls."""
    target, none = F.col("target_table"), F.lit(None).cast("string")

    def link(table: Column, direction: Column, neighbour: Column) -> Column:
        return F.struct(table.alias("table"), direction.alias("direction"), neighbour.alias("neighbour"))

    up, down = F.lit("upstream"), F.lit("downstream")
    known = target.isNotNull()
    rows = F.concat(
        F.transform("source_tables", lambda s: link(s, F.when(known, down), target)),
        F.transform("source_tables", lambda s: link(target, F.when(known, up), F.when(known, s))),
        F.array(link(target, none, none)),
    )
    return statements(queries, sql).select(F.inline(rows)).where("table IS NOT NULL").distinct()


def neighbours(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """Distinct rows (table, direction, neighbour); a table without any has one row with nulls."""
    seen = _links(queries, sql)
    linked = seen.where("direction IS NOT NULL")
    lonely = seen.groupBy("table").agg(F.max("direction").alias("direction"), F.lit(None).cast("string").alias("neighbour"))
    return linked.unionByName(lonely.where("direction IS NULL"))


def table_lineage(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """Rows (table, upstream_tables, downstream_tables) for every table seen, lists sorted.

    A table with very many neighbours makes a long list; ``neighbours`` gives the same as rows.
    """
    rows = _links(queries, sql)
    of = lambda direction: F.sort_array(
        F.collect_list(F.when(F.col("direction") == direction, F.col("neighbour")))
    )
    return rows.groupBy("table").agg(of("upstream").alias("upstream_tables"), of("downstream").alias("downstream_tables"))
