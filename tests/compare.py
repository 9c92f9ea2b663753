"""python tests/compare.py SF QUERY...: queries against their SQL, with times."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

import oracle  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main(sf: str, names: list[str]) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf)
    q, sql = entry.queries(), entry.oracle_sql()
    for name in names or sorted(q):
        t = time.time()
        try:
            cols, got = oracle.spark_rows(q[name](spark, f"{oracle.DATA}/{sf}"))
            took = time.time() - t
            if name not in sql:
                print(f"{name}: {len(got)} rows, no SQL, {took:.1f} s", flush=True)
                continue
            wcols, want = oracle.sql_rows(con, sql[name])
            ok = cols == wcols and got == want
            print(f"{name}: {'OK' if ok else 'DIFFERENT'} {len(got)} {len(want)} rows, {took:.1f} s", flush=True)
            if not ok:
                a, b = set(map(repr, got)), set(map(repr, want))
                print("  columns", cols, wcols, "\n  only here", sorted(a - b)[:3], "\n  only SQL", sorted(b - a)[:3], flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {str(e)[:1500]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
