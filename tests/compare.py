"""Run registered queries beside their SQL on DuckDB: ``python tests/compare.py [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set enable_progress_bar = false")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        text = v.isoformat()
        return text[:10] if text.endswith("T00:00:00") else text
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, [tuple(_cell(r[c]) for c in names) for r in df.collect()]


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    got = [d[0] for d in cur.description]
    names = sorted(got)
    at = [got.index(c) for c in names]
    return names, [tuple(_cell(r[i]) for i in at) for r in cur.fetchall()]


def _key(row):
    return tuple((v is None, str(type(v).__name__ == "str"), str(v)) for v in row)


def compare(df, con, sql) -> str:
    a_names, a = rows_of_spark(df)
    b_names, b = rows_of_duck(con, sql)
    if a_names != b_names:
        return f"columns {sorted(set(a_names) ^ set(b_names))}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = sorted(a, key=_key), sorted(b, key=_key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        cells = [(n, p, q) for n, p, q in zip(a_names, x, y) if p != q]
        return f"{len(bad)} of {len(a)} rows differ; first: {cells[:4]} at {x[:6]}"
    return f"ok {len(a)} rows" if a else "ok EMPTY"


def main(names):
    import __spark_entry__ as entry
    from panelspark.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            text = compare(df, con, oracle[name]) if name in oracle else f"no sql, {df.count()} rows"
        except Exception as e:  # report and go on
            text = f"ERROR {type(e).__name__} {str(e)[:600]}"
        failed += not text.startswith(("ok", "no sql"))
        print(f"{name:42s} {time.time() - t:6.1f}s  {text}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
