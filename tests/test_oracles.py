import os

import pytest

import __spark_entry__
from tests.compare import spark_rows, sql_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CIVIC, SQL = __spark_entry__._civic()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    names, want = sql_rows(SF, SQL[name])
    got_names, got = spark_rows(CIVIC[name](spark, SF))
    assert got_names == names
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(CIVIC) - set(SQL)))
def test_runs(spark, name):
    CIVIC[name](spark, SF).collect()
