"""Run a registered query and its SQL twin on the same tables and compare all rows."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import SparkSession

import workload
from workload.common import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "<nan>"
        return f"f:{value + 0.0!r}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in data)


def differences(spark: SparkSession, con, name: str, sf_dir: str, show: int = 3) -> list[str]:
    """Empty when both engines give the same columns and rows."""
    df = workload.QUERIES[name](spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    rel = con.sql(workload.ORACLE[name])
    theirs = rel.fetchall()
    out = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} != {sorted(rel.columns)}"]
    a, b = _rows(df.columns, mine), _rows(list(rel.columns), theirs)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
        out.append(f"columns {sorted(df.columns)}")
        out += [f"spark  {x}" for x in only_a[:show]] + [f"duckdb {x}" for x in only_b[:show]]
    return out
