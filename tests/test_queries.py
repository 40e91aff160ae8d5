import pytest
from differential import rows, tables

from menurank.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_same_rows_as_sql(spark, con, name):
    got = rows(registry.QUERIES[name](spark, SF).toPandas())
    assert got == rows(con.execute(registry.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == registry.TOP
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["snapshot_round_trip", "live_or_snapshot", "positional_zip", "order_statistics", "school_pages", "range_checks", "profile_faults"])
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(1).count() == 1
