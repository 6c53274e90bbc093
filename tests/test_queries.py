"""Every query against its SQL, and those without any for rows and columns."""

import pytest

from polymera.plans import catalog
from tests.compare import rows_of, rows_of_sql

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf_dir, duck):
    names, rows = rows_of(QUERIES[name](spark, sf_dir))
    want_names, want = rows_of_sql(duck, ORACLES[name])
    assert names == want_names
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries())
