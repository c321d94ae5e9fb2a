"""Every registered library query against its SQL on the smallest driver tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import duck, same
from shelfwise.plans import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_same_rows(spark, con, name):
    same(queries.queries()[name](spark, SF), con, oracle.oracle_sql()[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["catalog_id", "title", "author", "category", "similarity_score", "thumbs_up"]
    df.collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())
