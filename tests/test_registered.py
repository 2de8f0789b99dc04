"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from cuetable.checks.registry import collect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = collect("QUERIES"), collect("SQL")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    from compare import duck
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    from compare import compare
    ok, note, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_names():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 100
