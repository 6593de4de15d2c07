"""The entry point with and without the training-data operators."""

import importlib
import sys

import pytest

import __spark_entry__
from hopboard.plans.catalog import QUERIES
from hopboard.plans.oracle import ORACLE_SQL


@pytest.mark.parametrize("missing", ["hopboard.llm", "tiktoken"])
def test_other_queries_do_not_need_the_training_data_operators(monkeypatch, missing):
    """Without the subpackage, or without a package that it needs."""
    for name in [name for name in sys.modules if name.startswith("hopboard.llm") or name == missing]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr("hopboard.llm", raising=False)
    monkeypatch.setitem(sys.modules, missing, None)
    try:
        bare = importlib.reload(__spark_entry__)
        assert bare.queries() == QUERIES and bare.oracle_sql() == ORACLE_SQL
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
