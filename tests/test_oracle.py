"""Every registered query against its DuckDB oracle on the smallest test tables (the
driver repeats this at sf0.01); queries without an oracle must at least run."""

import pytest

from tessera.plans.catalog import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF_SMALL)
    assert r["ok"], r


def test_entry_contract(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    assert df.count() >= 0
    assert set(ent.oracle_sql()) <= set(ent.queries())
