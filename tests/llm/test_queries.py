import os

import pytest

import oracle_check
from weirflow.llm import queries

needs_data = pytest.mark.skipif(not os.path.isdir(oracle_check.DATA), reason="the test tables are not here")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    oracle_check.check(spark, queries.queries()[name], queries.oracle_sql()[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    found = queries.queries()[name](spark, oracle_check.DATA)
    assert found.count() == spark.read.parquet(f"{oracle_check.DATA}/documents.parquet").count()
