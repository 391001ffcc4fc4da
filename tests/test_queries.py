"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest
from compare import compare, connect

from __spark_entry__ import ORACLE, QUERIES, entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry_has_rows(spark):
    assert not entry(spark).isEmpty()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    extra, missing, _ = compare(spark, sql, QUERIES[name], ORACLE[name], SF)
    assert not extra and not missing
