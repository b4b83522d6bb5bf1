"""Every core query with SQL against DuckDB, and the others for being runnable."""

import pytest

from conftest import SF
from talkweave.plans import CORE_QUERIES, CORE_SQL


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_same_as_sql(spark, same, name):
    same(CORE_QUERIES[name](spark, SF), CORE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE_QUERIES) - set(CORE_SQL)))
def test_runs(spark, name):
    assert CORE_QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
