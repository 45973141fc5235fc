"""Compare registered queries with their DuckDB oracles.

usage: check_oracle.py [--sf DIR] [key-or-module ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from leafmill.registry import load_all  # noqa: E402
from leafmill.session import get_spark  # noqa: E402
from leafmill.sources.tables import SCHEMAS  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v != 0 else 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return repr(v)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    if a.keys and any(k.startswith("@") for k in a.keys):
        import importlib

        from leafmill.registry import QUERIES

        for k in a.keys:
            importlib.import_module(f"leafmill.plans.{k[1:]}")
        qs = {k: q for k, q in QUERIES.items() if q.fn.__module__.split(".")[-1] in [m[1:] for m in a.keys]}
    else:
        qs = load_all()
        if a.keys:
            qs = {k: qs[k] for k in a.keys}
    spark = get_spark("leafmill-tools", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"create view {t} as select * from read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for key, q in qs.items():
        try:
            t0 = time.time()
            df = q(spark, a.sf)
            cols = sorted(df.columns)
            got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
            t1 = time.time()
            if q.sql is None:
                print(f"ROWS {key:28s} n={len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            res = con.execute(q.sql)
            names = [d[0] for d in res.description]
            order = [names.index(c) for c in sorted(names)]
            want = sorted(tuple(norm(r[i]) for i in order) for r in res.fetchall())
            t2 = time.time()
            ok = cols == sorted(names) and got == want
            print(f"{'ok  ' if ok else 'FAIL'} {key:28s} n={len(got)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"
                  + ("  EMPTY" if not got else ""), flush=True)
            if not ok:
                bad += 1
                print("   cols", cols, sorted(names), "rows", len(got), len(want))
                g, w = set(got) - set(want), set(want) - set(got)
                for r in sorted(g)[:3]:
                    print("   spark", str(r)[:600])
                for r in sorted(w)[:3]:
                    print("   duck ", str(r)[:600])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {key}: {str(e)[:700]}", flush=True)
    print(f"{len(qs)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
