"""Compare catalogue queries with their SQL twins in DuckDB.

Usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value: object) -> object:
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float):
        return value + 0.0
    return value


def canonical(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=repr)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> str | None:
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    got_names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_names, want = canonical([d[0] for d in result.description], result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"{str(g)[:300]} != {str(w)[:300]}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from raregrain.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in sqls:
                message = compare(spark, con, sf, name, fn, sqls[name])
                state = "ok" if message is None else "DIFF " + message
            else:
                state = f"rows {len(fn(spark, sf).collect())}"
        except Exception as error:  # noqa: BLE001
            state = "FAIL " + str(error).strip()[:700]
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    print("bad:", bad)
    sys.exit(bool(bad))
