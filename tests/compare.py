"""Run registered queries beside their check SQL: `python tests/compare.py [sf] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value



def difference(spark_frame: DataFrame, sf_dir: str, check: str) -> str | None:
    """None when both give the same rows and columns, else what differs."""
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = connection.execute(check)
    wanted_names = [d[0] for d in cursor.description]
    wanted = [dict(zip(wanted_names, row)) for row in cursor.fetchall()]
    names = sorted(spark_frame.columns)
    if names != sorted(wanted_names):
        return f"columns {names} and {sorted(wanted_names)}"
    found = Counter(tuple(_plain(row[n]) for n in names) for row in spark_frame.collect())
    expected = Counter(tuple(_plain(row[n]) for n in names) for row in wanted)
    types = [type(v).__name__ for v in next(iter(found), ())]
    sql_types = [type(v).__name__ for v in next(iter(expected), ())]
    if found == expected:
        if types != sql_types and "NoneType" not in types + sql_types:
            return f"types {types} and {sql_types}"
        return None
    extra, missing = found - expected, expected - found
    return (
        f"{sum(found.values())} rows against {sum(expected.values())}; {sum(extra.values())} differ; "
        f"first {names}: {next(iter(sorted(extra, key=str)), None)} against {next(iter(sorted(missing, key=str)), None)}"
    )


def main() -> None:
    from effortlens.plans.catalog import CHECKS, QUERIES
    from effortlens.session import spark_session

    scale, *chosen = sys.argv[1:] or ["0.01"]
    spark = spark_session(
        spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{scale}"
    failed = 0
    for name, query in QUERIES.items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in CHECKS:
                found = difference(frame, sf_dir, CHECKS[name])
            else:
                rows = frame.collect()
                found = None if rows else "no rows"
                name += f" ({len(rows)} rows, no SQL)"
        except Exception as error:  # report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {time.time() - start:6.1f}s {name} {found or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
