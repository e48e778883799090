"""Compare registered queries with their SQL run by DuckDB.

``python tests/oracle.py [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat(sep=" ", timespec="microseconds")
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return float(value)
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = zip(*[[_cell(v) for v in frame[c].tolist()] for c in columns])
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else the first difference."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows against {len(sql_frame)}"
    for c in spark_frame.columns:
        kinds = {spark_frame[c].dtype.kind, sql_frame[c].dtype.kind}
        if len(kinds) > 1 and not kinds <= {"f", "i", "u"} and "O" not in kinds:
            return f"column {c}: {spark_frame[c].dtype} against {sql_frame[c].dtype}"
    left, right = rows_of(spark_frame), rows_of(sql_frame)
    for a, b in zip(left, right):
        if a != b:
            return f"{sum(x != y for x, y in zip(left, right))} rows differ: {a} against {b}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from sensorframe.session import build_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "check",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            frame = query(spark, sf_dir).toPandas()
            took = time.time() - began
            note = "no SQL" if name not in oracles else compare(frame, con.sql(oracles[name]).df()) or "equal"
        except Exception as error:
            took, note, frame = time.time() - began, f"ERROR {str(error)[:900]}", []
        bad += note not in ("equal", "no SQL")
        print(f"{name:28s} {took:6.2f}s {len(frame):8d} rows  {note}", flush=True)
    return bad


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(folder, sys.argv[2:]))
