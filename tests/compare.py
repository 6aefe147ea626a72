"""Run registered queries in both engines and compare rows.

    python tests/compare.py [sf folder] [query ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        return "∅" if math.isnan(value) else f"{value:.6f}"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, folder):
    df = query(spark, folder)
    left = rows_of(df.columns, df.collect())
    if sql is None:
        return len(left[1]), "rows only"
    cur = con.execute(sql)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return len(left[1]), f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        a, b = set(left[1]) - set(right[1]), set(right[1]) - set(left[1])
        return len(left[1]), (
            f"rows {len(left[1])} != {len(right[1])}: only spark {sorted(a)[:2]} only sql {sorted(b)[:2]}")
    return len(left[1]), "ok"


def main():
    from __spark_entry__ import oracle_sql, queries
    from offerloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("local[8]", 8), connect(folder)
    registered, sqls = queries(), oracle_sql()
    assert set(sqls) <= set(registered), set(sqls) - set(registered)
    bad = []
    for name in sys.argv[2:] or registered:
        t = time.time()
        try:
            n, result = compare(spark, con, name, registered[name], sqls.get(name), folder)
        except Exception as e:  # report and go on
            n, result = -1, f"{type(e).__name__}: {str(e)[:300]}"
        print(f"{name:28s} {n:8d} {time.time() - t:6.1f}s {result}", flush=True)
        if result not in ("ok", "rows only"):
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
