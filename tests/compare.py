"""Compare registered queries with their SQL: ``python tests/compare.py [sf] [key ...]``."""
from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from ramparts.sources.derived import BASE_TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in data)


def difference(spark_df, con, sql: str):
    """None if equal, else a short text; also the number of rows."""
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    began = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rows(names, rel.fetchall())
    difference.sql_seconds = time.time() - began
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}", sum(got.values())
    if got != want:
        return (f"{sum(got.values())} vs {sum(want.values())} rows; only ours {list((got - want).items())[:3]}; "
                f"only sql {list((want - got).items())[:3]}"), sum(got.values())
    return None, sum(got.values())


if __name__ == "__main__":
    from conftest import make_session

    import __spark_entry__ as entry
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark, con = make_session(), connect(sf)
    wanted = sys.argv[2:]
    for key, run in entry.queries().items():
        if wanted and key not in wanted:
            continue
        began = time.time()
        sql = entry.oracle_sql().get(key)
        try:
            if sql is None:
                print(f"rows  {key} {run(spark, sf).count()} {time.time() - began:.1f}s", flush=True)
                continue
            wrong, n = difference(run(spark, sf), con, sql)
            print(f"{'ok   ' if wrong is None else 'WRONG'} {key} {n} {time.time() - began - difference.sql_seconds:.1f}s (sql {difference.sql_seconds:.1f}s) {wrong or ''}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {key} {str(e)[:600]}", flush=True)
