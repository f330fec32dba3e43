"""Every registered query against DuckDB, on whole tables of the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks import duckdb_sql, queries
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = queries.queries()
SQL = duckdb_sql.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    difference, rows = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert difference is None
    assert rows > 0


#: these write or stream before they return
WRITING = {"q_file_run", "q_sinks", "q_stream_scan", "q_block_latch", "q_latest_findings",
           "q_rescan_policy", "q_ordered_findings"}
#: two scans of each row by definition; UTF-16 units only where a text has such characters
TWICE = {"q_offsets", "q_json_report_utf16"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_one_scan_per_query(spark, name):
    """A detector's pattern is in the plan once for its matches and once for their positions."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    scans = 2 if name in TWICE else 1
    assert plan.count("AKIA(?<!") <= 2 * scans
    # 17 in a scan; redaction and lines cut texts into pieces, exact redaction at two places
    assert plan.count("regexp_extract_all(") <= 17 * scans + 2


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["doc_id", "type"] and df.count() > 0
