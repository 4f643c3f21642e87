"""Every registered query of the ledger next to its SQL twin."""

import pytest

import __spark_entry__ as contract
import compare
from passbook.plans import batch, streams

NAMES = sorted(batch.QUERIES | streams.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare.difference(spark, con, sf_dir, name) == ""


def test_every_query_has_a_twin():
    assert set(contract.oracle_sql()) & set(NAMES) == set(NAMES)
