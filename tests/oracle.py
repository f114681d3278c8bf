"""Runs registered queries beside their SQL and compares every value. Usage: python tests/oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def _norm(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return x


def compare(spark_df, con, sql: str):
    """None when equal, else a short description of the first difference."""
    names = sorted(spark_df.columns)
    left = [tuple(_norm(r[c]) for c in names) for r in spark_df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {sorted(cols)} != {names}"
    order = [cols.index(c) for c in names]
    right = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    if len(left) != len(right):
        return f"rows spark={len(left)} sql={len(right)}"
    types = [{type(x) for x in col if x is not None} for col in zip(*left)], [{type(x) for x in col if x is not None} for col in zip(*right)]
    if types[0] != types[1]:
        return f"types {types}"
    a, b = Counter(left), Counter(right)
    if a != b:
        only_a, only_b = list((a - b).elements()), list((b - a).elements())

        def key(r):
            return tuple(str(x) for x in r if not isinstance(x, float))
        only_a.sort(key=key), only_b.sort(key=key)
        return f"{len(only_a)} of {len(left)} rows differ {names}\n   spark {only_a[:2]}\n   sql   {only_b[:2]}"
    return None


def connect(sf_dir: str):
    import duckdb
    from tidemark.catalog.views import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(argv):
    from tidemark.session import build_session
    import __spark_entry__ as entry
    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, jobs, sql = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in jobs:
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            df = jobs[name](spark, sf_dir)
            if name in sql:
                diff = compare(df, con, sql[name])
                n = ""
            else:
                rows = df.count()
                diff, n = (None if rows else "no rows"), f"rows-only {rows}"
        except Exception as e:  # report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += diff is not None
        if diff is not None or argv[1:] or time.time() - t > 8:
            print(("OK  " if diff is None else "FAIL"), name, f"{time.time() - t:.1f}s", n, diff or "", flush=True)
    print("failures", bad, "of", len(jobs))


if __name__ == "__main__":
    main(sys.argv[1:])
