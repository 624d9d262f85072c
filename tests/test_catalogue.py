"""Every query of the catalogue against DuckDB over the smallest tables."""

import pytest

import oracle
from clipquery.plans import catalogue
from conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_rows_equal(spark, con, name):
    assert oracle.differences(catalogue.QUERIES[name](spark, SMALL), con, catalogue.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "doc_id", "bm25_score", "rank"] and df.count() > 0
