import __spark_entry__ as entry


def test_entry_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:4] == ["CustomerID", "Recency", "Frequency", "Monetary"]
    assert entry.entry(spark).schema == df.schema


def test_registered_keys_are_lower_case_ids():
    assert all(key == key.lower() for key in entry.queries())
    assert not any(key.startswith("op") for key in entry.registry.QUERIES)
