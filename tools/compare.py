"""Run registered queries on Spark and their SQL on DuckDB and compare all values.

usage: python tools/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import importlib.util
import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, connection, run, sql, sf_dir):
    started = time.time()
    df = run(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    if not sql:
        return f"rows {len(got)}", seconds, 0.0, None
    started = time.time()
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want_columns, want = rows_of(names, result.fetchall())
    sql_seconds = time.time() - started
    if got_columns != want_columns:
        return "COLUMNS", seconds, sql_seconds, (got_columns, want_columns)
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"DIFF {len(got)}/{len(want)}", seconds, sql_seconds, diff
    return f"ok {len(got)}", seconds, sql_seconds, None


def main() -> int:
    import duckdb

    from tabloom.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    connection = duckdb.connect()
    connection.execute("set TimeZone='UTC'")
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    module = entry_module()
    spark = local_session("compare", cpus=8)
    queries, oracle = module.queries(), module.oracle_sql()
    bad = 0
    for name in args.names or queries:
        try:
            status, seconds, sql_seconds, detail = compare(spark, connection, queries[name], oracle.get(name), sf_dir)
        except Exception as error:  # report and go on to the next query
            status, seconds, sql_seconds, detail = "ERROR", 0.0, 0.0, str(error).splitlines()[:6]
        failed = not status.startswith(("ok", "rows"))
        bad += failed
        print(f"{name:32s} {status:14s} {seconds:7.2f}s {sql_seconds:7.2f}s", detail or "", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
