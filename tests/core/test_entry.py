import __spark_entry__ as e


def test_entry(spark):
    got = e.entry(spark)
    assert got.columns == ["part", "type", "n"] and got.count() > 5


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
