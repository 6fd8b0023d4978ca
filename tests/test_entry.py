import importlib.util
import os


def test_entry_contract(spark):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    df = m.entry(spark)
    assert df.count() > 0
    assert "tenant_id" in df.columns and "load_date" in df.columns
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
