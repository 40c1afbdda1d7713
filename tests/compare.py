"""Compares registered queries with their DuckDB SQL: python tests/compare.py SF_DIR [name part...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if type(x).__name__ in ("Decimal",):
        return round(float(x), 6) + 0.0
    return x


def rows_of(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    got = con.execute(sql)
    cols = [d[0] for d in got.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def differ(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows."""
    a, b = rows_of(query(spark, sf_dir)), rows_of_sql(sf_dir, sql)
    if a == b:
        return ""
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    left, right = set(a[1]), set(b[1])
    only = [x for x in a[1] if x not in right][:3], [x for x in b[1] if x not in left][:3]
    return f"{len(a[1])} and {len(b[1])} rows; only in Spark {only[0]}; only in SQL {only[1]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.checkpoint.dir", "/tmp/compare-checkpoints").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in queries:
        if len(sys.argv) > 2 and not any(x in name for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            if name in oracle:
                n = differ(spark, sys.argv[1], queries[name], oracle[name])
                print(f"{'ok  ' if not n else 'DIFF'} {name} {time.time() - t:.1f} s {n[:1500]}", flush=True)
            else:
                df = queries[name](spark, sys.argv[1])
                print(f"rows {name} {df.count()} {time.time() - t:.1f} s {df.columns}", flush=True)
        except Exception as e:
            print(f"FAIL {name} {type(e).__name__} {str(e)[:1500]}", flush=True)
