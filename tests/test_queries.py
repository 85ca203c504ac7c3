import pytest
from compare import connect, same

from fathomgrid.plans import registry

SF = "/root/testdata/sf0.01"
ALL = registry.all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, x in ALL.items() if x.sql])
def test_query_equals_sql(spark, duck, name):
    same(ALL[name].spark(spark, SF).toPandas(), duck.execute(ALL[name].oracle()).df())


@pytest.mark.parametrize("name", [n for n, x in ALL.items() if not x.sql])
def test_query_has_rows(spark, name):
    df = ALL[name].spark(spark, SF)
    assert df.count() > 0
    assert df.columns == [c.partition(":")[0] for c in ALL[name].columns.split()]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
