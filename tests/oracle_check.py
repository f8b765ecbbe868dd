"""Runs registered queries on Spark and their SQL on DuckDB and compares rows.

``python tests/oracle_check.py [sf] [name…]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def _near(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_near(x, y) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def compare(spark, con, run, sql, d):
    """(verdict, rows): equal, near (rounding only), or what differs. Without SQL only the rows are counted."""
    df = run(spark, d)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows-only", len(got)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    if got == want:
        types = [(type(x).__name__, type(y).__name__) for a, b in zip(got[:50], want[:50]) for x, y in zip(a, b) if type(x) is not type(y)]
        return (f"types {types[:3]}" if types else "equal"), len(got)
    bad = [(a, b) for a, b in zip(got, want) if not _near(a, b)]
    if not bad:
        return "near", len(got)
    return f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}", len(got)


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    d = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    names = argv[1:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    runs, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names:
        start = time.time()
        try:
            verdict, n = compare(spark, con, runs[name], sql.get(name), d)
        except Exception as e:  # noqa: BLE001
            verdict, n = "ERROR " + " ".join(str(e).split("JVM stacktrace")[0].split())[:500], -1
        ok = verdict in ("equal", "near", "rows-only") and n > 0
        failed += not ok
        print(f"{'ok ' if ok else 'BAD'} {name}: {verdict} rows={n} {time.time() - start:.1f}s", flush=True)
    print(f"{len(names)} queries, {failed} bad")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
