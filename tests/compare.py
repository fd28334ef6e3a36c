"""Run registered queries and their expected-result SQL side by side.

    python tests/compare.py [--sf DIR] [name-prefix ...]
"""
from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("quillfolio")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def expected_db(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, db, name, call, sql, sf_dir):
    start = time.time()
    df = call(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return f"rows {len(got)}", spent, 0.0
    start = time.time()
    cur = db.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    took = time.time() - start
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(cols)}", spent, took
    if got == want:
        return f"ok {len(got)}", spent, took
    only = [r for r in got if r not in set(want)][:3]
    miss = [r for r in want if r not in set(got)][:3]
    return f"DIFF got {len(got)} want {len(want)}\n  cols {sorted(cols)}\n  got  {only}\n  want {miss}", spent, took


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    import __spark_entry__ as entry

    spark, db, sql = session(), expected_db(sf_dir), entry.oracle_sql()
    bad = []
    for name, call in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        try:
            verdict, spent, took = compare(spark, db, name, call, sql.get(name), sf_dir)
        except Exception as e:  # report and go on to the next query
            verdict, spent, took = f"ERROR {type(e).__name__} {str(e)[:700]}", 0, 0
        if not verdict.startswith(("ok", "rows")):
            bad.append(name)
        print(f"{name:34s} {spent:6.2f}s {took:6.2f}s {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
