import pytest

from tokenweir.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(name, spark, data, duck, same):
    same(catalog.QUERIES[name](spark, data), duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
