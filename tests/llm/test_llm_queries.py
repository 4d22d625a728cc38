"""Queries with SQL against DuckDB on the smallest tables."""

import pytest
from compare import check, duck

from tallyframe.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    out = check(spark, duck(FOLDER), name, QUERIES[name], SQL[name], FOLDER)
    assert out.startswith("ok"), out


def test_entry_points():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
