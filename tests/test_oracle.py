"""Every registered query that has SQL against it, on the smallest sample."""

import pytest

import __spark_entry__ as contract
from checks.compare import compare, connect
from checks.queries import QUERIES

CHOSEN = [n for n in QUERIES if QUERIES[n].sql]


@pytest.mark.parametrize("name", CHOSEN)
def test_same_as_sql(spark, sample, name):
    same, rows, _, note = compare(spark, connect(sample), sample, name)
    assert same, note
    assert rows > 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
