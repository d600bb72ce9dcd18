"""Compare registered queries with their SQL on DuckDB.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return repr(v)
        if isinstance(v, float):
            if math.isnan(v):
                return "nan"
            return repr(v + 0.0)
        return f"{type(v).__name__}:{v!r}"

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(con, sql, df):
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. only spark {sorted(set(got) - set(want))[:2]} only sql {sorted(set(want) - set(got))[:2]}"
    if got != want:
        a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"{got_cols}: {len(a)} rows differ; spark {a[:3]} sql {b[:3]}"
    return ""


def main(argv):
    from verdikt.plans.catalog import QUERIES, SQL
    from verdikt.session import build_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session("check", 8)
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in SQL:
                problem = compare(con, SQL[name], df)
                note = "ok" if not problem else "DIFF " + problem
            else:
                problem, note = "", f"rows {df.count()}"
        except Exception as err:  # noqa: BLE001
            problem = note = f"ERROR {type(err).__name__}: {str(err)[:700]}"
        bad += bool(problem)
        print(f"{name:32s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
