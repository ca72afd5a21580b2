"""Every registered query on the smallest data: rows, and equality with its SQL."""

import pytest

from loreline.plans.catalog import ORACLES, QUERIES
from tests.compare import compare, database

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, problem = compare(spark, con, name, QUERIES, ORACLES, SF_DIR)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
