"""Every query with an SQL statement, against DuckDB on the smallest tables."""

from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from conftest import SF_DIR  # noqa: E402
from tools.check_catalog import compare, connect  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    result = compare(spark, con, name, SF_DIR)
    assert result in ("", "EMPTY on both sides"), result


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
