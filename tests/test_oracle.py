"""Differential tests: every SQL-expressible key equals its DuckDB oracle (sf0.001)."""

import pytest

from demandlake.plans.catalog import ORACLE, QUERIES
from demandlake.plans.verify import compare, duck_connect

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_key_matches_oracle(spark, duck, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[key]).df()
    ok, msg = compare(got, want)
    assert ok, msg


def test_every_key_registered_in_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 90


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["hour", "mean", "std"]
    assert df.count() == 24
