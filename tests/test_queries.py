"""Every registered query of the core against its SQL."""

import pytest
from conftest import DATA, same

from turnstone.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and rows == sorted(rows, key=lambda r: -r["score"])
    assert set(entry.oracle_sql()) <= set(entry.queries())
