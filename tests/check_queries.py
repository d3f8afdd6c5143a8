"""Compare registered queries with their oracle text: python tests/check_queries.py [sf] [name-part ...]"""

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from tests.conftest import make_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    spark = make_session()
    con = duckdb.connect()
    base = f"/root/testdata/sf{sf}"
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    sqls, bad = oracle_sql(), []
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, base)
            cols = sorted(df.columns)
            rows = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
            took = time.time() - t0
            if name not in sqls:
                print(f"----  {name:32s} {sum(rows.values()):8d} rows {took:6.1f}s (no oracle)", flush=True)
                continue
            t1 = time.time()
            res = con.sql(sqls[name])
            want_cols = [d[0] for d in res.description]
            order = [want_cols.index(c) for c in cols] if sorted(want_cols) == cols else None
            if order is None:
                raise AssertionError(f"columns {cols} vs {sorted(want_cols)}")
            want = Counter(tuple(norm(r[i]) for i in order) for r in res.fetchall())
            ok = rows == want
            print(f"{'ok  ' if ok else 'FAIL'}  {name:32s} {sum(rows.values()):8d} rows {took:6.1f}s oracle {time.time()-t1:5.1f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   spark only:", list((rows - want).items())[:3], "\n   oracle only:", list((want - rows).items())[:3],
                      "\n   types", df.dtypes, [str(x) for x in res.types], flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERR   {name:32s} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
