"""Run registered queries in Spark and DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, entry, sf_dir):
    """-> (status, message, spark rows, seconds)"""
    from cindergrid.catalog.base import run

    start = time.time()
    df = run(entry, spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if entry.sql is None:
        return ("rows", "", len(got), took)
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return ("FAIL", f"columns {sorted(names)} vs {sorted(df.columns)}", len(got), took)
    if len(got) != len(want):
        return ("FAIL", f"{len(got)} rows vs {len(want)}; e.g. {got[:2]} vs {want[:2]}", len(got), took)
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return ("FAIL", f"{len(bad)} rows differ, {sorted(names)}: {bad[:2]}", len(got), took)
    return ("ok", "", len(got), took)


def main(argv):
    import __spark_entry__ as e

    e.queries()
    from cindergrid.catalog.base import ENTRIES

    sf = "/root/testdata/sf0.01"
    picks = []
    for a in argv:
        if a.startswith("/"):
            sf = a
        else:
            picks.append(a)
    spark, con = session(), connect(sf)
    failed = []
    for name, entry in ENTRIES.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            status, message, n, took = compare(spark, con, entry, sf)
        except Exception as ex:  # report and go on
            status, message, n, took = "ERROR", str(ex)[:1500], -1, 0.0
        print(f"{status:5s} {name:36s} {n:8d} rows {took:6.2f}s {message}", flush=True)
        if status in ("FAIL", "ERROR"):
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    main(sys.argv[1:])
