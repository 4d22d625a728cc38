"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import check, duck

from tallyframe.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    out = check(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    assert not out.startswith("FAIL"), out


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["metric", "key", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())
