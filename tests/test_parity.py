"""Every registered query equals its SQL on the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracles
from parity import compare, database
from playlens.plans import registry

QUERIES = registry.queries()
STATEMENTS = oracles.ORACLES


@pytest.fixture(scope="session")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    verdict, _, _, note = compare(spark, con, sf_dir, name, QUERIES[name], STATEMENTS.get(name))
    assert verdict == "ok", note


def test_every_statement_has_a_query():
    assert set(STATEMENTS) == set(QUERIES)


def test_entry_has_rows_and_a_schema(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["session_id", "player_name"]
    assert frame.count() == 199
