"""Every registered query of the engine, against SQL over the same tables where there is any."""

import pytest

import compare
from quadloom import catalog


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, con, name):
    df = catalog.QUERIES[name](spark, small)
    if name in catalog.ORACLE:
        compare.check(df, con, catalog.ORACLE[name])
    else:
        df.collect()


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["c", "n", "region"]
