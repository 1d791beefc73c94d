"""Run registered queries beside their SQL and compare: ``python tests/check_queries.py [sf] [prefix ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def duck(sf_dir: str):
    from workloads.testbed import BASE_TABLES
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_value(r[i]) for i in order) for r in rows)


def compare(name: str, df, con, sql: str) -> tuple[bool, str, int]:
    spark_cols, left = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    duck_cols = [d[0] for d in result.description]
    duck_types = {d[0]: str(d[1]) for d in result.description}
    duck_cols, right = _rows(duck_cols, result.fetchall())
    want = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    types = [f"{c}: {t} / {duck_types.get(c)}" for c, t in df.dtypes if want.get(t) != duck_types.get(c)]
    n = sum(left.values())
    if spark_cols != duck_cols:
        return False, f"columns {spark_cols} / {duck_cols}", n
    if types:
        return False, f"types {types}", n
    if left != right:
        a, b = list((left - right).items())[:2], list((right - left).items())[:2]
        return False, (f"rows {n} / {sum(right.values())}, differing {sum((left - right).values())}\n   spark {str(a)[:900]}\n   sql   {str(b)[:900]}"), n
    return True, "", n


def main() -> None:
    from candisieve.session import build_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    prefixes = tuple(args[1:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad, unchecked = [], []
    for name, fn in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in checks:
                ok, why, n = compare(name, df, con, checks[name])
            else:
                ok, why, n = None, "no SQL to compare with", len(df.collect())
        except Exception as error:  # report and go on
            ok, why, n = False, str(error)[:1500], -1
        print(f"{'ok  ' if ok else 'none' if ok is None else 'FAIL'} {name:42s} {n:7d} rows {time.time() - start:6.2f}s {why}", flush=True)
        if not ok:
            (unchecked if ok is None else bad).append(name)
    print("failed:", bad, "without a check:", unchecked)
    sys.exit(bool(bad or unchecked))


if __name__ == "__main__":
    main()
