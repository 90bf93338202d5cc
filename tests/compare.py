"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from dealsift.catalog.records import TABLES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(f"{float(value):.9g}")
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """Empty text when equal, else what differs; plus the timings."""
    start = time.time()
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spark_seconds = time.time() - start
    if sql is None:
        return "", spark_seconds, 0.0, sum(got[1].values())
    start = time.time()
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    duck_seconds = time.time() - start
    problem = ""
    if got[0] != want[0]:
        problem = f"columns {got[0]} != {want[0]}"
    elif got[1] != want[1]:
        extra, missing = got[1] - want[1], want[1] - got[1]
        problem = (f"rows {sum(got[1].values())} vs {sum(want[1].values())}; {sum(extra.values())} only in Spark, "
                   f"{sum(missing.values())} only in SQL\n   columns {got[0]}\n   spark {list(extra)[:3]}\n   sql   {list(missing)[:3]}")
    return problem, spark_seconds, duck_seconds, sum(got[1].values())


def session():
    from dealsift.session import build_session

    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not args.names or any(n.startswith(a) for a in args.names)]
    spark, con, bad = session(), connect(sf_dir), 0
    for name in names:
        try:
            problem, s, d, n = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem, s, d, n = f"{type(error).__name__}: {str(error)[:900]}", 0, 0, 0
        bad += bool(problem)
        mark = "FAIL" if problem else ("ok" if name in oracles else "rows")
        print(f"{mark:4} {name:28} rows={n:<7} spark={s:.2f}s duckdb={d:.2f}s {problem}", flush=True)
    print(f"{len(names)} queries, {bad} failed, {sum(n in oracles for n in names)} with SQL")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
