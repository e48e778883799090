"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from sensorframe.queries import all_oracles, all_queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    frame = all_queries()[name](spark, sf_dir).toPandas()
    if name in all_oracles():
        assert compare(frame, con.sql(all_oracles()[name]).df()) is None


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
