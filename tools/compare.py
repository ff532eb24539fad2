"""Runs registered queries next to their SQL in DuckDB and reports differences.

usage: python tools/compare.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return repr(0.0 if value == 0 else round(value, 6))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(canonical(v) for v in value.values()) + "}"
    if hasattr(value, "asDict"):
        return "{" + ",".join(canonical(v) for v in value) + "}"
    if type(value).__name__ == "Decimal":
        return "decimal:" + str(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return ("ROWS", f"{len(got)} rows", seconds)
    cur = con.execute(sql)
    columns, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(columns) != sorted(got_columns):
        return ("COLS", f"{sorted(got_columns)} vs {sorted(columns)}", seconds)
    a, b = rows_of(got_columns, got), rows_of(columns, want)
    if a == b:
        return ("OK", f"{len(a)} rows", seconds)
    first = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return ("DIFF", f"{len(a)} vs {len(b)} rows; {first}", seconds)


def main():
    from catalog import ORACLES, QUERIES
    from treeline import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            status, note, seconds = compare(spark, con, sf_dir, name, fn, ORACLES.get(name))
        except Exception as e:
            status, note, seconds = "FAIL", str(e).replace("\n", " ")[:400], 0.0
        bad += status not in ("OK", "ROWS")
        print(f"{status:5} {seconds:6.2f}s {name}: {note[:400]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
