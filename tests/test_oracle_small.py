"""Every registered query against its DuckDB oracle on the smallest data set."""

import math

import duckdb
import pandas as pd
import pytest

from opslake.plans import registry
from opslake.sources.tables import TABLES

from conftest import SF_SMALL

registry.load_all()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 2 ** 53 else repr(round(v, 6))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if v is pd.NaT:
        return "NULL"
    return str(v)


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = _rows(registry.QUERIES[name](spark, SF_SMALL).toPandas())
    want = _rows(con.execute(registry.ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
