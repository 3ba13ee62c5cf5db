import os

import pytest

import __spark_entry__
import oracle_check
from weirflow import queries, registry

needs_data = pytest.mark.skipif(not os.path.isdir(oracle_check.DATA), reason="the test tables are not here")


def test_names():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found)
    assert set(queries.queries()) <= set(found)
    # one name for each operation but those that adapters define
    assert len(registry.OPERATIONS) == 43


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    oracle_check.check(spark, queries.queries()[name], queries.oracle_sql()[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, oracle_check.DATA).count() > 0
