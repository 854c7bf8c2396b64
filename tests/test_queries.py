"""Every query of the curation library against its SQL, over the same views; the entry point."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import compare

import __spark_entry__ as entry_point
from sievework.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert set(catalog.QUERIES) <= set(entry_point.queries())
