"""Every registered query against its SQL on the derived tables."""

import pytest

from __spark_entry__ import entry, oracle_sql
from checks.compare import check
from checks.registry import all_queries
from conftest import SF_DIR

QUERIES, ORACLE = all_queries(), oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck_con, name):
    assert check(spark, duck_con, SF_DIR, QUERIES[name], ORACLE[name]) is None
