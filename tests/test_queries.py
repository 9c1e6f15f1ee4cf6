import pytest

from sarstack.plans.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    # a series with any gap has no decomposition, and at the smallest scale each has one
    got = QUERIES[name](spark, SF.replace("0.001", "0.01") if name == "stl" else SF)
    assert got.columns and got.count() > 0
    got.write.format("noop").mode("overwrite").save()  # every row, every column


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
