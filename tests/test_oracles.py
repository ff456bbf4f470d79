"""Every registered query against its DuckDB oracle (sf0.001)."""

from conftest import SF001
from oracle_compare import compare


def test_all_registered_queries(spark):
    import __spark_entry__ as E
    from weftcore.plans.registered import QUERIES
    out = compare(spark, SF001, list(QUERIES), verbose=False)
    bad = {k: v for k, v in out.items() if v[0] != "MATCH"}
    assert not bad, bad
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["pid", "weight"] and 0 < len(rows) <= 50
