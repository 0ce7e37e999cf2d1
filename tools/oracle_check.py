"""Run registered queries in Spark and their oracle SQL in DuckDB; compare rows and values.

    python tools/oracle_check.py [sf_dir] [name ...]

Comparison: same column names, same row count, and the same multiset of rows after
rounding floats to 6 places (order-insensitive).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from memlake.plans import load_all  # noqa: E402
from memlake.session import get_spark  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    queries, oracle = load_all()
    spark = get_spark()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for name in (names or sorted(queries)):
        t0 = time.time()
        try:
            sdf = queries[name](spark, sf)
            scols = sdf.columns
            srows = [tuple(norm(x) for x in r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"ROWS  {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(oracle[name])
            ocols = [d[0] for d in res.description]
            orows = [tuple(norm(x) for x in r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(ocols):
            print(f"FAIL  {name}: columns spark={scols} oracle={ocols}")
            bad += 1
            continue
        stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
        otypes = dict(zip(ocols, [str(d[1]) for d in res.description]))
        tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN", "float": "FLOAT"}
        tdiff = [(c, stypes[c], otypes[c]) for c in scols
                 if tmap.get(stypes[c], stypes[c]).upper() != otypes[c].upper()]
        if tdiff:
            print(f"TYPE  {name}: {tdiff}")
        idx = [ocols.index(c) for c in scols]
        orows = [tuple(r[i] for i in idx) for r in orows]
        a, b = sorted(srows, key=key), sorted(orows, key=key)
        if a == b:
            print(f"OK    {name}: {len(a)} rows {ts:.1f}s")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL  {name}: rows spark={len(a)} oracle={len(b)}; "
                  f"only-spark={list(sa - sb)[:2]} only-oracle={list(sb - sa)[:2]}")
    print(f"{bad} failing")
    spark.stop()


if __name__ == "__main__":
    main()
