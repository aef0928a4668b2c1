"""Every registered query against its DuckDB oracle (sf0.001 here; the driver uses sf0.01),
and the driver contract of __spark_entry__."""

import pytest

from conftest import SF0001
from opsight.plans.check import compare, duck
from opsight.plans.registry import load_all

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, QUERIES[key], ORACLES.get(key), SF0001)
    assert r["status"] in ("ok", "no-oracle"), r


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0 and "health_status" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
    # every query of the library has an oracle
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())
