"""Run every query next to its SQL statement in DuckDB and compare rows.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from buyerlens.registry import load  # noqa: E402
from buyerlens.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    queries, oracle = load()
    wanted = args[1:] or list(queries)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in wanted:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(x) for x in df.collect()])
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {str(err)[:600]}", flush=True)
            continue
        took = time.time() - t0
        spark.catalog.clearCache()
        if name not in oracle:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(oracle[name])
            cols = [d[0] for d in cur.description]
            kinds = {d[0]: str(d[1]) for d in cur.description}
            want = rows_of(cols, cur.fetchall())
        except Exception as err:  # noqa: BLE001
            bad += 1
            print(f"SQL   {name}: {str(err)[:600]}", flush=True)
            continue
        if sorted(cols) != sorted(df.columns):
            bad += 1
            print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(cols)}", flush=True)
        elif got != want:
            bad += 1
            diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows; {sorted(cols)} {diff}", flush=True)
        else:
            types = {c: t for c, t in df.dtypes}
            odd = {
                c: (types[c], kinds[c])
                for c in cols
                if (types[c], kinds[c])
                not in {
                    ("bigint", "BIGINT"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("date", "DATE"),
                    ("boolean", "BOOLEAN"), ("timestamp_ntz", "TIMESTAMP"), ("int", "INTEGER"),
                }
            }
            note = f" types {odd}" if odd else ""
            print(f"ok    {name}: {len(got)} rows {took:.1f}s{note}", flush=True)
    print(f"{bad} bad of {len(wanted)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
