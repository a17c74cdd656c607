"""Every registered query with an oracle against DuckDB at the smallest scale; the rest must run."""

import pytest

import __spark_entry__ as entry
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, con, key):
    out = check(QUERIES[key](spark, SF), ORACLES[key], con)
    assert out.startswith("ok"), out


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"fecha", "score", "label"} <= set(df.columns)
