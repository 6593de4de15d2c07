"""Every query against the SQL of the same name, run by DuckDB on the same files."""

import os
from dataclasses import replace
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, queries
from hopboard.plans.catalog import QUERIES, SKETCH_PARAMS
from hopboard.plans.oracle import ORACLE_SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def sort_key(row):
    return tuple((value is not None, str(value)) for value in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    result = queries()[name](spark, SF_DIR)
    expected = duck.execute(ORACLE_SQL[name])
    columns = [column[0] for column in expected.description]
    assert sorted(result.columns) == sorted(columns)
    got = sorted((tuple(row) for row in result.select(*columns).collect()), key=sort_key)
    want = sorted(expected.fetchall(), key=sort_key)
    assert len(got) == len(want) > 0
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", ["sketch_accuracy", "top_approx", "top_approx_direct"])
def test_estimates_are_compared_for_real(spark, name, monkeypatch):
    """Sketches far too small for the data must show."""
    monkeypatch.setattr("hopboard.plans.catalog.SKETCH_PARAMS", replace(SKETCH_PARAMS, lg_k=4))
    assert not all(row["within_tolerance"] for row in queries()[name](spark, SF_DIR).collect())


def test_flagship_query(spark):
    result = entry(spark)
    assert result.columns == ["rank", "query", "count"]
    assert [row["rank"] for row in result.collect()] == list(range(1, 21))
