"""The operators' queries next to their DuckDB equivalents."""

from __future__ import annotations

import pytest

from checks.compare import compare, connect
from inkveil.llm.duckdb_sql import oracle_sql
from inkveil.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal(spark, con, name):
    difference, _ = compare(spark, con, queries()[name], oracle_sql()[name], FOLDER)
    assert difference is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, FOLDER).count() > 0
