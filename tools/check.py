"""Run registered queries against their SQL in DuckDB: ``python tools/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import importlib.util
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def load_entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


TIMES: dict[str, float] = {}


def _canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, int):
        return v
    return str(v)


def compare(df, con, sql: str) -> str:
    """'' when both sides agree, else what differs."""
    cols = sorted(df.columns)
    t0 = time.time()
    ours = [tuple(_canon(r[c]) for c in cols) for r in df.collect()]
    TIMES["spark"] = time.time() - t0
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    theirs = [tuple(_canon(r[i]) for i in order) for r in cur.fetchall()]
    TIMES["sql"] = time.time() - t0
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    for a, b in zip(sorted(ours, key=key), sorted(theirs, key=key)):
        if a != b:
            return f"{cols}: {a} vs {b}"
    types = [f.dataType.simpleString() for f in sorted(df.schema.fields, key=lambda f: f.name)]
    if any("decimal" in t for t in types):
        return f"decimal type {types}"
    return ""


def main() -> None:
    from crossfactor.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    module = load_entry()
    sqls, con, bad = module.oracle_sql(), duck(sf), 0
    for name, fn in module.queries().items():
        if args and name not in args:
            continue
        t0 = time.time()
        TIMES.clear()
        try:
            df = fn(spark, sf)
            TIMES["build"] = time.time() - t0
            if name in sqls:
                msg = compare(df, con, sqls[name])
            else:
                rows = df.count()
                msg = "" if rows else "no rows"
                name += f" (no SQL, {rows} rows)"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        spark.catalog.clearCache()
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {time.time() - t0:6.1f}s {name} {' '.join(f'{k}={v:.1f}' for k, v in TIMES.items())} {msg}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
