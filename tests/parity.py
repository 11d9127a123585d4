"""Run registered queries and their SQL side by side: ``python tests/parity.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pandas as pd

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
        return ""
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str, run, statement: str | None):
    """(verdict, seconds, rows, note)"""
    started = time.time()
    frame = run(spark, sf_dir)
    got = frame.collect()
    seconds = time.time() - started
    if statement is None:
        return "rows", seconds, len(got), ""
    cursor = con.execute(statement)
    columns = [item[0] for item in cursor.description]
    want = cursor.fetchall()
    if sorted(frame.columns) != sorted(columns):
        return "COLUMNS", seconds, len(got), f"{sorted(frame.columns)} vs {sorted(columns)}"
    mine, theirs = rows_of(frame.columns, got), rows_of(columns, want)
    if mine == theirs:
        return "ok", seconds, len(got), ""
    extra = [row for row in mine if row not in set(theirs)][:2]
    missing = [row for row in theirs if row not in set(mine)][:2]
    return "DIFF", seconds, len(got), f"{len(mine)} vs {len(theirs)}; extra {extra}; missing {missing}"


def main() -> None:
    from playlens.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    statements = entry.oracle_sql()
    bad = []
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        try:
            verdict, seconds, count, note = compare(spark, con, sf_dir, name, run, statements.get(name))
        except Exception as error:  # report and go on with the next query
            verdict, seconds, count, note = "ERROR", 0.0, 0, str(error)[:900]
        print(f"{verdict:8s}{seconds:7.2f}s {count:7d}  {name}  {note}", flush=True)
        if verdict not in ("ok", "rows"):
            bad.append(name)
    print(f"{len(bad)} not equal: {bad}")
    unknown = set(statements) - set(entry.queries())
    print(f"statements without query: {sorted(unknown)}")


if __name__ == "__main__":
    main()
