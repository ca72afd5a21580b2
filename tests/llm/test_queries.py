"""Every query of the folder against its SQL, on the smallest data and on rows made to be awkward."""

import pytest

from loreline.llm.queries import ORACLES, QUERIES
from tests.compare import compare, database
from tests.llm.awkward import DOCUMENTS, write_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, problem = compare(spark, con, name, QUERIES, ORACLES, SF_DIR)
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_rows(spark, tmp_path, name):
    write_tables(spark, tmp_path, DOCUMENTS)
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) == {"op5": 9, "op6": 7, "op11": 7, "op12": 9, "op13": 0}.get(name.split("_")[0], len(DOCUMENTS))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    write_tables(spark, tmp_path, [], empty=True)
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
