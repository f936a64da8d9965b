"""Compare every registered query with its oracle SQL, or time the queries.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    plan = df._jdf.queryExecution().executedPlan().toString()
    loops = [n for n in ("CartesianProduct", "BroadcastNestedLoopJoin") if n in plan]
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if sql is None:
        return "ROWS", took, f"{len(got)} rows {kinds} {loops or ''}"
    start = time.time()
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want_kinds = {d[0]: str(d[1]).upper() for d in rel.description}
    want = rel.fetchall()
    duck_took = time.time() - start
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of(want_cols, want)
    problems = []
    if gc != wc:
        problems.append(f"columns {gc} != {wc}")
    if len(gr) != len(wr):
        problems.append(f"rows {len(gr)} != {len(wr)}")
    fixed = {k: {"NUMBER": "BIGINT", "STRING": "VARCHAR", "BOOL": "BOOLEAN"}.get(v, v) for k, v in want_kinds.items()}
    if any(kinds.get(k) != v for k, v in fixed.items()):
        problems.append(f"types {kinds} != {want_kinds}")
    if gr != wr:
        a, b = set(gr), set(wr)
        problems.append(f"values differ: only spark {sorted(a - b, key=repr)[:3]} only sql {sorted(b - a, key=repr)[:3]}")
    if not gr:
        problems.append("no rows")
    return ("OK" if not problems else "BAD"), took, f"{len(gr)} rows, sql {duck_took:.1f}s " + " | ".join(problems) + (f" {loops}" if loops else "")


def main():
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, took, note = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on to the next query
            status, took, note = "ERR", 0.0, str(error).strip()[:700].replace("\n", " ")
        bad += status in ("BAD", "ERR")
        print(f"{status:5s} {name:34s} {took:6.2f}s {note}", flush=True)
    print(f"{bad} problem(s)")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
