"""Compare registered queries with their oracle texts: ``python -m hearthgrid.catalog.check [names]``."""

from __future__ import annotations

import sys
import time

import pandas as pd

from . import load
from .base import TABLES
from ..session import local_session


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False):
        out = []
        for v in r:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                out.append("NULL")
            elif isinstance(v, bool):
                out.append(str(v))
            elif hasattr(v, "tolist") and not isinstance(v, str):
                v = v.tolist()
                out.append(repr(v) if not isinstance(v, float) else f"{v:.6g}")
            elif isinstance(v, float):
                out.append(f"{v:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v)))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def duck_types(con, sql):
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


def main(sf: str, names: list[str]) -> int:
    import duckdb

    queries, oracles = load()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            got = sdf.toPandas()
        except Exception as e:
            print(f"FAIL {name}: {str(e)[:600]}", flush=True)
            bad += 1
            continue
        took = time.time() - t0
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            if not len(got):
                bad += 1
            continue
        try:
            want = con.execute(oracles[name]).df()
            types = duck_types(con, oracles[name])
        except Exception as e:
            print(f"FAIL {name} oracle: {str(e)[:600]}", flush=True)
            bad += 1
            continue
        if sorted(got.columns) != sorted(want.columns):
            print(f"FAIL {name}: columns {sorted(got.columns)} / {sorted(want.columns)}", flush=True)
            bad += 1
            continue
        a, b = canonical(got), canonical(want)
        pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp": "TIMESTAMP", "date": "DATE", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]"}
        off = [(c, t, types[c]) for c, t in sdf.dtypes if pairs.get(t, "?") != types[c]]
        note = f" types {off}" if off else ""
        if a != b or not a:
            bad += 1
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"FAIL {name}: rows {len(a)}/{len(b)} cols {sorted(got.columns)} first {diff}{note} {took:.1f}s", flush=True)
        else:
            print(f"ok   {name}: {len(a)} rows {took:.1f}s{note}", flush=True)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    raise SystemExit(1 if main(folder, args) else 0)
