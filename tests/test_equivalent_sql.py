"""Every registered query gives the rows of its SQL on the same tables."""

import pytest
from compare import connect, differences

from docketry.plans.oracle import ORACLES
from docketry.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, tables, con, name):
    ours, theirs, rows, columns = differences(spark, tables, name, con)
    assert columns is None
    assert not ours and not theirs, (list(ours)[:3], list(theirs)[:3])


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
