"""Runs registered queries next to their SQL on DuckDB and compares values. Usable as a script:

    python tests/compare.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


TIMES: dict[str, float] = {}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return repr(v)


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), sorted(names)


def compare(spark, con, fn, sql: str, sf_dir: str):
    """None when equal, otherwise a short description."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    TIMES["spark"] = time.time() - t0
    got, gn = canon(rows, df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want, wn = canon(cur.fetchall(), names)
    if gn != wn:
        return f"columns {gn} != {wn}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} differ, e.g. {bad[0]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    import __spark_entry__ as E
    from tideline.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sys.argv[1])
    qs, os_ = E.queries(), E.oracle_sql()
    for name, fn in qs.items():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        t0 = time.time()
        try:
            if name in os_:
                msg, n = compare(spark, con, fn, os_[name], sys.argv[1])
            else:
                msg, n = None, fn(spark, sys.argv[1]).count()
        except Exception as e:  # noqa: BLE001
            msg, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} rows={n} {time.time() - t0:.1f}s (spark {TIMES.get('spark', 0):.1f}) {'' if name in os_ else '(no sql)'} {msg or ''}", flush=True)
