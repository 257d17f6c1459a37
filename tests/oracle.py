"""Run a registered query on Spark and its SQL on DuckDB and compare every value.

    python tests/oracle.py SF_DIR [query ...]
"""

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in records)


def compare(spark, con, sf_dir, name, run, sql):
    """None when equal, otherwise what differs."""
    df = run(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    want = _rows(columns, cursor.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}; e.g. {got[:2]} vs {want[:2]}"
    if not got:
        return "both sides empty"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ in {sorted(columns)}: {bad[:3]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from panelcast.queries import CHECKS, QUERIES

    sf = sys.argv[1]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(sf)
    failures = 0
    for query in sys.argv[2:] or list(QUERIES):
        started = time.time()
        try:
            problem = compare(session, connection, sf, query, QUERIES[query], CHECKS.get(query))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {query} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{failures} failures")
