"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check_oracles


@pytest.fixture(scope="module")
def con(sf_dir):
    return check_oracles.database(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, sf_dir, name):
    status, note = check_oracles.compare(spark, con, name, sf_dir)
    assert status in ("ok", "rows"), note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    answered = entry.entry(spark)
    assert answered.columns == ["query_id", "status", "top_score", "message"]
    assert answered.count() > 0
