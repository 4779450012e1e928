"""Compares registered queries with their DuckDB equivalents: ``python tests/oracle.py [SF_DIR] [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, int):
        return float(value) if abs(value) < 1 << 53 else value
    return str(value)


def rows_of(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    other = con.execute(sql)
    theirs_names = [d[0] for d in other.description]
    if sorted(df.columns) != sorted(theirs_names):
        return f"columns {sorted(df.columns)} and {sorted(theirs_names)}"
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(theirs_names, other.fetchall())
    if ours == theirs:
        return "" if ours else "no rows"
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:2]}; only there {list((theirs - ours).items())[:2]}"


def main(args: list[str]) -> int:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = args[0] if args else "/root/testdata/sf0.001"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = database(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in args[1:] or [q for q in queries if q in oracles]:
        began = time.time()
        try:
            said = difference(spark, con, queries[name], oracles[name], sf_dir)
        except Exception as e:  # reported, and the others go on
            said = f"{type(e).__name__}: {str(e)[:400]}"
        bad += bool(said)
        print(f"{name} {time.time() - began:.1f} s {said or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
