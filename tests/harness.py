"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python -m tests.harness [--sf 0.01] [name ...]
Compares row count, column names and the multiset of rows (doubles rounded
to 6 places), the same shape of check the correctness gate applies.
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in sdf.collect()])
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = rows_of(d_cols, res.fetchall())
    t2 = time.time()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={sorted(s_cols)} duck={sorted(d_cols)}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    elif s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
        problems.append(f"{len(diff)} differing rows, first: {repr(diff[0])[:600]}")
    return dict(name=name, ok=not problems, rows=len(s_rows), spark_s=round(t1 - t0, 2),
                duck_s=round(t2 - t1, 2), problems=problems)


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    sf_dir = f"/root/testdata/sf{a.sf}"
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from textlens.session import build_session
    spark = build_session()
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    names = a.names or list(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, qs[n], orc.get(n), sf_dir, con)
        except Exception as e:  # report and continue
            r = dict(name=n, ok=False, problems=[f"{type(e).__name__}: {str(e)[:800]}"])
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED {bad} of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
