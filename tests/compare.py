"""Runs registered queries next to their SQL twins and compares rows.

    python tests/compare.py [--sf 0.01] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import importlib
import sys
import time
import traceback

import duckdb

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 2**50 else str(v)
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def table_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, query, sql):
    t0 = time.time()
    df = query(spark, sf_dir)
    got_cols, got = table_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"ROWS  {name} rows={len(got)} spark={t1 - t0:.1f}s", True
    res = con.execute(sql)
    exp_cols, exp = table_of([d[0] for d in res.description], res.fetchall())
    t2 = time.time()
    msg = f"{name} rows={len(got)}/{len(exp)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if got_cols != exp_cols:
        return f"COLS  {msg}\n   spark {got_cols}\n   sql   {exp_cols}", False
    if got != exp:
        a, b = set(got), set(exp)
        return (
            f"DIFF  {msg}\n   cols {got_cols}\n   spark only {sorted(a - b)[:3]}\n   sql only   {sorted(b - a)[:3]}",
            False,
        )
    return f"ok    {msg}" + ("  EMPTY" if not got else ""), True


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--failed", action="store_true", help="print failures only")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from tracefield.session import local_session

    entry = importlib.import_module("__spark_entry__")
    spark = local_session("compare")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = n = 0
    for name, q in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        n += 1
        try:
            msg, ok = compare(spark, con, sf_dir, name, q, sqls.get(name))
        except Exception as exc:
            msg, ok = f"FAIL  {name} {type(exc).__name__}: {str(exc)[:900]}", False
            if args.names and len(args.names) == 1:
                traceback.print_exc()
        bad += not ok
        if not (args.failed and ok):
            print(msg, flush=True)
    print(f"{n - bad}/{n} agree")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(bool(main()))
