"""Compares registered queries with their SQL twins on DuckDB.

usage: python tests/check_oracles.py [sf dir] [name prefix or regex ...]
"""

import os
import re
import sys
import time

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidemark.session import build_session  # noqa: E402


def kind(value):
    return "int" if isinstance(value, int) and not isinstance(value, bool) else type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def compare(spark, con, name, folder):
    started = time.time()
    df = entry.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"no sql  rows={len(got)}  {took:.1f}s", True
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} <> {sorted(columns)}", False
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return f"ok      rows={len(a)}  {took:.1f}s" + ("   EMPTY" if not a else ""), True
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    bad = len(set(a) ^ set(b))
    return (f"DIFF rows {len(a)} / {len(b)}, differing {bad}\n   cols  {sorted(columns)}\n   spark {only_a}"
            f"\n   sql   {only_b}"), False


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    failed = []
    for name in entry.queries():
        if wanted and not any(re.match(w, name) for w in wanted):
            continue
        try:
            text, fine = compare(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001
            text, fine = f"ERROR {type(error).__name__} {str(error)[:900]}", False
        print(f"{name:34s} {text}", flush=True)
        if not fine:
            failed.append(name)
    print("FAILED", len(failed), failed)


if __name__ == "__main__":
    main()
