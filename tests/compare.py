"""Run the registered queries and their SQL side by side.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, build, sql, sf_dir):
    """Differing rows: only in Spark, only in SQL."""
    frame = build(spark, sf_dir)
    found = rows_of(frame.columns, frame.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return sorted(frame.columns), sorted(names), 0
    wanted = rows_of(names, cursor.fetchall())
    return found - wanted, wanted - found, sum(found.values())


def main(sf_dir, only):
    from __spark_entry__ import oracle_sql, queries

    from shelfledger.session import build_session

    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, build in queries().items():
        if only and name not in only:
            continue
        begun = time.time()
        try:
            extra, missing, count = compare(spark, con, build, oracle_sql()[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}")
            bad += 1
            continue
        took = time.time() - begun
        if extra or missing:
            bad += 1
            print(f"DIFF {name} rows={count} extra={len(extra)} missing={len(missing)} {took:.1f}s")
            print("   spark", sorted(map(str, extra))[:2])
            print("   sql  ", sorted(map(str, missing))[:2])
        else:
            print(f"ok   {name} rows={count} {took:.1f}s", flush=True)
    print("not equal:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], set(sys.argv[2:]))
