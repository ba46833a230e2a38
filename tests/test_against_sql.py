"""Every registered query against its SQL counterpart."""

import pytest

from checks.compare import connect, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES
from groundwell.sources.documents import list_documents
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal(spark, database, name):
    assert differences(QUERIES[name](spark, SMALL), database, ORACLE[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_both_outcomes_occur(spark):
    rows = QUERIES["grounded_answers"](spark, SMALL).collect()
    assert {r["answered"] for r in rows} == {True, False}
    assert any(r["retrieved_chunks"] == 0 for r in rows)
    assert any(r["finish_reason"] and not r["answered"] for r in rows)


def test_listing(spark):
    names = [r["file_name"] for r in list_documents(spark, SMALL, [".parquet"]).collect()]
    assert names == sorted(names) and "documents.parquet" in names
