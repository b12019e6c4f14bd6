"""Every registered query against its SQL on DuckDB."""

import os

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    own = {name for name, query in queries().items() if query.__module__.startswith("fleetwatch") and ".llm" not in query.__module__}
    assert own <= set(SQL) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    try:
        assert differences(spark, con, queries()[name], SQL[name], FOLDER) == []
    except AssertionError as error:
        # at the smallest scale some rules find nothing; an empty result on both sides is fine
        if "no rows" not in str(error) or con.execute(SQL[name]).fetchall():
            raise
