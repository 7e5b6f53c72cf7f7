"""Comparison of a query with its SQL on the same Parquet tables.

    python tests/oracle.py [--sf 0.01] NAME...
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, plain(y)) for k, y in sorted(x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return x


def rows_of(frame) -> Counter:
    names = sorted(frame.columns)
    return Counter(tuple(plain(row[c]) for c in names) for row in frame.select(*[f"`{c}`" for c in names]).collect())


def rows_by_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())


def compare(frame, sql: str, sf_dir: str) -> str:
    """An empty string if both agree, else what differs."""
    names, want = rows_by_sql(sql, sf_dir)
    if sorted(frame.columns) != names:
        return f"columns {sorted(frame.columns)} and {names}"
    got = rows_of(frame)
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only ours: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args[:1] == ["--sf"] and args.pop(0) else "0.01"
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        began = time.time()
        try:
            frame = queries[name](session, DATA + sf)
            said = compare(frame, oracle[name], DATA + sf) if name in oracle else f"rows only: {frame.count()}"
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {said[:1800] or 'equal'} ({time.time() - began:.1f} s)", flush=True)
