"""Run registered queries and their SQL side by side: python -m checks.compare [folder] [names...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.queries import QUERIES
from tariffscope.session import drop_staged, local_session

SAMPLE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SAMPLE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in answer.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    return names, sorted(rows, key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[bool | None, int, float, str]:
    query = QUERIES[name]
    start = time.time()
    names, mine = spark_rows(query.run(spark, folder))
    took = time.time() - start
    if query.sql is None:
        return None, len(mine), took, ""
    other_names, other = sql_rows(con, query.sql)
    if names != other_names:
        return False, len(mine), took, f"columns {names} / {other_names}"
    if mine == other:
        return True, len(mine), took, ""
    left, right = set(mine), set(other)
    only, extra = sorted(left - right, key=repr)[:2], sorted(right - left, key=repr)[:2]
    return False, len(mine), took, f"{len(mine)} / {len(other)} rows; spark {only}; sql {extra}"


if __name__ == "__main__":
    chosen_folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    session, connection = local_session(), connect(chosen_folder)
    bad = 0
    for query_name in chosen:
        try:
            same, count, seconds, note = compare(session, connection, chosen_folder, query_name)
        except Exception as problem:
            same, count, seconds, note = False, 0, 0.0, f"{type(problem).__name__}: {str(problem)[:600]}"
        drop_staged(session)
        bad += same is False
        print(f"{ {True: 'same', False: 'DIFF', None: 'rows'}[same] } {query_name} {count} {seconds:.1f}s {note}", flush=True)
    print(f"{bad} differ")
