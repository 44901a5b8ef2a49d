import pytest
from compare import same

from evenhand.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_gives_the_same_rows(spark, sf_dir, duck, name):
    assert same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_give_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count()


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count()
