"""Runs registered queries and compares them with their oracle SQL in DuckDB.

``python tests/compare.py [sf_dir] [key prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])


def duck(sf_dir: str):
    from paramo.plans.bindings import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == 0:
            return 0.0
        return round(v, 6) if abs(v) < 1e6 else float(f"{v:.12g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def near(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(near(x, y) for x, y in zip(a, b))
    return a == b


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")),
                  f"{v:.3f}" if isinstance(v, (int, float)) else str(v)) for v in row)


def check(df, sql, con) -> str:
    cols = sorted(df.columns)
    got = [tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"COLUMNS spark={cols} duck={sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    if len(got) != len(want):
        return f"ROWS spark={len(got)} duck={len(want)}"
    got.sort(key=sort_key), want.sort(key=sort_key)
    bad = [(g, w) for g, w in zip(got, want) if not all(near(a, b) for a, b in zip(g, w))]
    if bad:
        return f"VALUES {len(bad)}/{len(got)} first: {cols} {bad[0]}"
    return f"ok {len(got)}"


def main(argv):
    import __spark_entry__ as entry
    from tests.conftest import make_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = make_session()
    con = duck(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for key, build in entry.queries().items():
        if len(argv) > 1 and not any(key.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            df = build(spark, sf)
            if key in oracles:
                out = check(df, oracles[key], con)
            else:
                out = f"ok {len(df.collect())} (rows only)"
        except Exception as err:  # report and go on with the next query
            out = f"ERROR {type(err).__name__}: {str(err)[:900]}"
        failed += not out.startswith("ok")
        print(f"{key:28s} {time.time() - start:6.1f}s {out}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
