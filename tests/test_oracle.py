"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from oracle import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, con, name):
    error, _, _ = compare(spark, con, name, registry.queries()[name], registry.oracle_sql()[name], FOLDER)
    assert error is None, error


def test_entry(spark):
    assert entry.entry(spark).count() > 0
