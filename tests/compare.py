"""Run queries and their SQL oracles on the same tables and compare the rows.

``python tests/compare.py [sf dir] [query …]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return str([normal(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """(equal, rows, message)"""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    other = rows_of(result.columns, result.fetchall())
    if mine[0] != other[0]:
        return False, len(mine[1]), f"columns {mine[0]} / {other[0]}"
    if mine[1] != other[1]:
        a, b = set(mine[1]), set(other[1])
        return False, len(mine[1]), f"{len(mine[1])}/{len(other[1])} rows, only here {list(a - b)[:3]}, only oracle {list(b - a)[:3]}"
    return True, len(mine[1]), ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from ecoframe.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracle:
                ok, n, message = compare(spark, con, query, oracle[name], sf_dir)
            else:
                n, ok, message = query(spark, sf_dir).count(), True, "no oracle"
        except Exception as error:
            ok, n, message = False, 0, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {n:8d} rows {time.time() - start:6.1f} s {message}", flush=True)
