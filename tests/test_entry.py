import __spark_entry__ as entry


def test_contract(spark):
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 30
    assert entry.entry(spark).count() > 0
