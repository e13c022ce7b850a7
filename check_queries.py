"""Run registered queries against their SQL counterparts in DuckDB and compare the values.

Usage: python check_queries.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from lumaforge.session import BUILD_CONF, configure
from lumaforge.workload import ORACLES, QUERIES, load_all


def make_session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config(map=BUILD_CONF)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canonical(r[i]) for i in order) for r in records]
    return [names[i] for i in order], sorted(out, key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int]:
    df = QUERIES[name](spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return "rows-only", len(got)
    cur = con.execute(ORACLES[name])
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return f"values differ ({len(got)} vs {len(want)} rows): {diff}", len(got)
    bad = [
        (n, repr(t)) for n, t in zip(df.columns, (f.dataType for f in df.schema.fields))
        if t.typeName() in ("array", "map", "struct", "void")
    ]
    return ("ok" if not bad else f"ok, nested columns {bad}"), len(got)


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [a for a in args if "/" not in a]
    load_all()
    spark, con = make_session(), connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            verdict, n = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001 - a report over all queries must not stop at one
            verdict, n = f"error {type(e).__name__}: {str(e)[:700]}", -1
        ok = verdict.startswith(("ok", "rows-only")) and n > 0
        failed += not ok
        print(f"{'  ' if ok else '!!'} {name:36s} {n:7d} rows {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
