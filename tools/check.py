"""Run registered queries on Spark and their checking SQL on DuckDB, and compare.

usage: check.py FOLDER [name-prefix ...]
"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from optlake import catalog
from optlake.catalog.registry import TABLES
from optlake.session import get_spark


def norm(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "~" if value != value else repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return repr(float(value)) if False else str(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        cells = []
        for i in order:
            x = r[i]
            cells.append(norm(x))
        out.append(tuple(cells))
    out.sort()
    return [names[i] for i in order], out


def main():
    folder, prefixes = sys.argv[1], sys.argv[2:]
    queries, oracles = catalog.load()
    spark = get_spark("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            t0 = time.time()
            df = fn(spark, folder)
            got = df.collect()
            t1 = time.time()
            head, a = rows_of(df.columns, got)
            if name not in oracles:
                print(f"rows {name}: {len(a)} rows, {t1 - t0:.1f}s")
                if not a:
                    bad.append(name)
                continue
            rel = con.execute(oracles[name])
            cols = [d[0] for d in rel.description]
            types = [str(d[1]) for d in rel.description]
            want = rel.fetchall()
            t2 = time.time()
            whead, b = rows_of(cols, want)
            flag = "ok"
            if head != whead or a != b:
                flag = "FAIL"
                bad.append(name)
            odd = [t for t in types if "HUGEINT" in t or "INT128" in t or "DECIMAL" in t or "LIST" in t or "[]" in t]
            print(f"{flag} {name}: {len(a)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s {odd or ''} {'EMPTY' if not a else ''}", flush=True)
            if flag == "FAIL":
                print("  columns", head, whead, len(a), len(b))
                sa, sb = set(a), set(b)
                print("  spark only", list(sorted(sa - sb))[:4], len(sa - sb))
                print("  sql only  ", list(sorted(sb - sa))[:4], len(sb - sa))
        except Exception as e:
            bad.append(name)
            print(f"ERROR {name}: {str(e)[:1500]}")
            tb = traceback.extract_tb(e.__traceback__)
            print("   at", [f"{f.filename.split('/')[-1]}:{f.lineno}" for f in tb if "optlake" in f.filename or "check" in f.filename])
    print("bad:", bad)


main()
