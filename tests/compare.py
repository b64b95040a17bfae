"""Compares a query with its SQL run by DuckDB over the same folder."""

from __future__ import annotations

import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'; SET enable_progress_bar=false")
    for f in sorted(os.listdir(folder)):
        path = os.path.join(folder, f)
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "item"):
        return plain(x.item())
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26].replace("+00:00", "")
    if type(x).__name__ == "Decimal":
        return plain(float(x))
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, sql: str, con) -> str:
    """Empty if both agree in columns and rows."""
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    want = rows(names, out.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))[:10]}"
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows, SQL {len(want)}; first got {got[:2]}, want {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            d = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if x != y]
            return f"row differs: {d[:5]} in {str(a)[:300]}"
    return ""


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, o, c = e.queries(), e.oracle_sql(), views(sf)
    names = [n for n in q if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            r = difference(q[n](spark, sf), o[n], c) if n in o else f"(no SQL) {len(q[n](spark, sf).collect())} rows"
        except Exception as x:  # noqa: BLE001
            r = "ERROR " + str(x)[:1500]
        bad += bool(r) and not r.startswith("(no")
        print(f"{n}: {r or 'ok'} {time.time() - t:.1f}s", flush=True)
    print(f"{len(names)} run, {bad} bad")
