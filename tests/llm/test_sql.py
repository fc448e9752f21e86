"""Queries of the text operators against their SQL."""

import os

import pytest
from oracle import _rows, duck

from tablewatch.llm.queries import ORACLE, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    mine = QUERIES[name](spark, SF)
    theirs = duck(SF).sql(ORACLE[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    got = _rows(mine.columns, [tuple(r) for r in mine.collect()])
    assert got and got == _rows(list(theirs.columns), theirs.fetchall())
