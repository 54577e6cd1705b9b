"""Every registered query of the library against its SQL."""

import pytest
from helpers import SMALL, oracle_rows, rows_of

from strandlake.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = rows_of(catalog.QUERIES[name](spark, SMALL))
    assert got[1]
    if name in catalog.ORACLES:
        assert got == oracle_rows(SMALL, catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).head(1)
    assert set(entry.oracle_sql()) <= set(entry.queries())
