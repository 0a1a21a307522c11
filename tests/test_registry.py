import __spark_entry__ as contract
from planeweave.plans import catalog


def test_every_query_has_check_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert len(catalog.QUERIES) > 120
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship_query(spark):
    result = contract.entry(spark)
    assert "attach_time_ms" in result.columns and result.count() == 8
