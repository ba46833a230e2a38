"""Runs registered queries in Spark and DuckDB and compares the rows.

    python -m checks.compare [sf_dir] [query ...]
"""

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    database = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        if os.path.exists(path):
            database.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return database


def canonical(columns, rows):
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else round(value, 6) + 0.0
        return value

    return [columns[i] for i in order], sorted(
        ([cell(row[i]) for i in order] for row in rows), key=repr
    )


def differences(frame, database, sql):
    """None when equal, else a short description."""
    columns, got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    result = database.sql(sql)
    wanted_columns, wanted = canonical(result.columns, result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} against {wanted_columns}"
    if len(got) != len(wanted):
        return f"{len(got)} rows against {len(wanted)}"
    for a, b in zip(got, wanted):
        if a != b:
            return f"{str(a)[:700]} against {str(b)[:700]}"
    return None


def main(sf_dir="/root/testdata/sf0.01", *names):
    from checks.oracle import ORACLE
    from checks.queries import QUERIES
    from groundwell.session import build_session

    spark = build_session("local[8]", spark__log__level="ERROR")
    spark.sparkContext.setLogLevel("ERROR")
    database = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            if name in ORACLE:
                verdict = differences(QUERIES[name](spark, sf_dir), database, ORACLE[name]) or "equal"
            else:
                verdict = f"no SQL, {QUERIES[name](spark, sf_dir).count()} rows"
        except Exception as error:  # report and go on with the next query
            verdict = f"FAILED {type(error).__name__}: {str(error)[:900]}"
        bad += not verdict.startswith(("equal", "no SQL"))
        print(f"{name}: {verdict} ({time.time() - started:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
