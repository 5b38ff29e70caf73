"""Every query of the catalog against its SQL."""

import pytest

from plumbline.plans.catalog import QUERIES, SQL
from tests.compare import rows
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, duck):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
