"""Every core query runs, and equals its SQL where it has one."""

import pytest
from checking import rows_of, rows_of_sql

from heliodor.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    if name in catalogue.SQL:
        assert rows_of(df) == rows_of_sql(catalogue.SQL[name], small)
    else:
        assert df.count() > 0


def test_every_check_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_search" in entry.queries()
