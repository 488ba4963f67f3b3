"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF_DIR, same_rows

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
TWINS = entry_point.oracle_sql()
WITHOUT_TWIN = sorted(set(QUERIES) - set(TWINS))


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_matches_twin(name, spark, duck):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    same_rows(got, duck.execute(TWINS[name]).df())


@pytest.mark.parametrize("name", WITHOUT_TWIN)
def test_returns_rows(name, spark):
    assert not QUERIES[name](spark, SF_DIR).isEmpty()


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() == 4
