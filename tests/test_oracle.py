"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import check, duck

from __spark_entry__ import entry, oracle_sql, queries
from veilwork.plans.oracle import ORACLE
from veilwork.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = check(spark, con, name, SF)
    assert ok, note


def test_contract(spark):
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 200
