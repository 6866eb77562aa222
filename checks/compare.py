"""Run queries on Spark and their SQL on DuckDB, and compare.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from checks.oracle import ORACLE
from checks.registry import QUERIES
from watchkeep.session import session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def normal(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str) -> tuple[str, float]:
    started = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if name not in ORACLE:
        return f"rows {len(got)}", took
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} <> {sorted(columns)}", took
    left, right = rows_of(df.columns, got), rows_of(columns, want)
    if left != right:
        only = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"DIFFERS {len(left)} <> {len(right)} {only}", took
    return f"equal {len(left)}", took


def main(folder: str, names: list[str]) -> int:
    spark = session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), 0
    for name in names or QUERIES:
        try:
            verdict, took = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            verdict, took = "ERROR " + str(error)[:600], 0.0
        failed += not verdict.startswith(("equal", "rows"))
        print(f"{name:28s} {took:6.2f}s  {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(main(arguments[0], arguments[1:]))
