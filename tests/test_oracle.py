"""Every registered query against SQL run by another engine."""

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_sql_names_are_registered():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, sf_dir):
    assert {r["metric"] for r in entry.entry(spark).collect()} == {"coherence", "correctness", "groundedness", "logical_consistency"}
