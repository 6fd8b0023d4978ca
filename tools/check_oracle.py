"""Run every registered query on Spark and its oracle on DuckDB, compare like the driver.

usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from opslake.plans import registry  # noqa: E402
from opslake.session import get_session  # noqa: E402
from opslake.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        return repr(round(v, 6))
    if hasattr(v, "item"):
        try:
            return norm(v.item())
        except Exception:
            pass
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v)


def digest(df: pd.DataFrame):
    cols = sorted(df.columns)
    rows = sorted("|".join(norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return cols, hashlib.md5("\n".join(rows).encode()).hexdigest(), rows


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    registry.load_all()
    extra = {}
    if os.environ.get("CHECK_TZ"):
        # mimic a foreign session: other zone, default (LTZ) timestamp type
        extra = {"spark.sql.session.timeZone": os.environ["CHECK_TZ"], "spark.sql.timestampType": "TIMESTAMP_LTZ"}
    spark = get_session(extra=extra)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for name, fn in sorted(registry.QUERIES.items()):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            pdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL-SPARK {name}: {type(e).__name__}: {str(e)[:400]}")
            traceback.print_exc(limit=2)
            continue
        dt = time.time() - t0
        sql = registry.ORACLES.get(name)
        if sql is None:
            print(f"rows-only {name}: {len(pdf)} rows {dt:.1f}s")
            continue
        try:
            odf = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL-ORACLE {name}: {str(e)[:400]}")
            continue
        sc, sh, sr = digest(pdf)
        oc, oh, orr = digest(odf)
        ok = sc == oc and sh == oh and len(pdf) == len(odf)
        if ok:
            print(f"ok {name}: {len(pdf)} rows {dt:.1f}s")
        else:
            bad += 1
            print(f"MISMATCH {name}: spark {len(pdf)} rows cols={sc} / oracle {len(odf)} rows cols={oc}")
            if sc == oc:
                a, b = set(sr), set(orr)
                print("   spark-only:", sorted(a - b)[:3])
                print("   oracle-only:", sorted(b - a)[:3])
            else:
                print("   spark dtypes:", dict(pdf.dtypes.astype(str)))
                print("   oracle dtypes:", dict(odf.dtypes.astype(str)))
        if ok:
            sd = {c: str(t) for c, t in pdf.dtypes.items()}
            od = {c: str(t) for c, t in odf.dtypes.items()}
            diff = {c: (sd[c], od.get(c)) for c in sd if sd[c] != od.get(c)}
            if diff:
                print(f"   dtype differences: {diff}")
    print(f"DONE bad={bad}")


if __name__ == "__main__":
    main()
