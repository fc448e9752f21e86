"""Every registered query against its SQL twin, over whole tables."""

import os

import oracle
import pytest

import workload

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(workload.ORACLE))
def test_query(spark, con, name):
    assert oracle.differences(spark, con, name, SF_DIR) == []


def test_every_query_has_sql():
    assert set(workload.QUERIES) == set(workload.ORACLE)
