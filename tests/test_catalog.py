"""Every query against its SQL twin on the smallest tables, and the coverage of the catalogue."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.columns == ["overall", "dataset", "emotion", "n", "exact_match", "mean_sentence_bleu"]
    assert df.filter("overall").count() == 1
