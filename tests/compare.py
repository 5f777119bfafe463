"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    """Comparable form of one cell; every float keeps all its digits."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, folder: str, query, sql: str | None) -> dict:
    start = time.time()
    df = query(spark, folder)
    got = [tuple(row) for row in df.collect()]
    out = {"rows": len(got), "sec": round(time.time() - start, 2)}
    if sql is None:
        return {**out, "ok": None}
    cursor = duck(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return {**out, "ok": False, "why": f"columns {sorted(df.columns)} != {sorted(names)}"}
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return {**out, "ok": True}
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return {**out, "ok": False, "why": f"{len(a)} vs {len(b)} rows; spark {only_a}; sql {only_b}"}


if __name__ == "__main__":
    from trustloom.plans import reference_sql, registered_queries
    from trustloom.session import build_session
    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sql = reference_sql()
    bad = 0
    for name, query in registered_queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            result = compare(spark, folder, query, sql.get(name))
        except Exception as error:  # report and go on with the next query
            result = {"ok": False, "why": f"{type(error).__name__}: {str(error)[:700]}"}
        bad += result["ok"] is False
        print(name, result, flush=True)
    print("failed:", bad)
