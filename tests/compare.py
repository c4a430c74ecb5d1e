"""Run registered queries and their SQL side by side: python tests/compare.py [sf] [names...]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
import traceback

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def canonical(columns: list[str], rows) -> list[tuple[str, ...]]:
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in places) for row in rows)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def differences(spark, con, name, query, sql, folder) -> str | None:
    df = query(spark, folder)
    columns, rows = duck_rows(con, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    got, want = spark_rows(df), canonical(columns, rows)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            wrong = sum(x != y for x, y in zip(got, want))
            return f"{wrong} rows differ, first {str(a)[:600]} against {str(b)[:600]}"
    return None


def main() -> int:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = root
    import __spark_entry__ as e
    from broadsheet.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        "compare",
        "local[8]",
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.session.timeZone": "UTC",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = e.queries(), e.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in sql:
                problem = differences(spark, con, name, queries[name], sql[name], folder)
                note = "equal" if problem is None else problem
            else:
                problem = None
                note = f"{queries[name](spark, folder).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            problem = note = f"{type(error).__name__}: {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} fine")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
