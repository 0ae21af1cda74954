def test_entry_runs(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 400
    assert df.columns == ["item_id", "rank", "chunk_id", "doc_id", "score"]
    assert all(1 <= r["rank"] <= 10 for r in rows)


def test_registry_keys_have_callables():
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
