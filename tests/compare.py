"""Run registered queries against their DuckDB text: python tests/compare.py SF [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df.select(*[f"`{c}`" for c in cols]).collect():
        out.append(tuple(norm(x.asDict(True) if hasattr(x, "asDict") else x) for x in r))
    return cols, sorted(out, key=repr)


def duck_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)


def main(sf, prefixes):
    from foldscope import runtime
    import __spark_entry__ as entry

    spark = runtime.session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/{sf}"
    con = connect(d)
    Q, O = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in Q.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            cols, rows = spark_rows(fn(spark, d))
            t1 = time.time()
            if name not in O:
                print(f"ROWS {name} {len(rows)} {t1 - t:.1f}s", flush=True)
                continue
            dc, dr = duck_rows(con, O[name])
            ok = cols == dc and rows == dr
            print(f"{'OK  ' if ok else 'DIFF'} {name} {len(rows)} {t1 - t:.1f}s duck {time.time() - t1:.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   cols", cols, dc)
                a, b = set(map(repr, rows)), set(map(repr, dr))
                print("   spark only", sorted(a - b)[:3], "\n   duck only", sorted(b - a)[:3], len(rows), len(dr))
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} {type(e).__name__} {str(e)[:700]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
