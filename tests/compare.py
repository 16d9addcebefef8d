"""Compare registered queries with DuckDB: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
spark_done = 0.0
DATA = Path("/root/testdata")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(spark_df, con, sql):
    """Both results as Arrow tables with sorted columns, registered for comparison."""
    spark_table = spark_df.toArrow()
    columns = sorted(spark_table.column_names)
    con.register("spark_side", spark_table.select(columns))
    global spark_done  # for the report of ``main``
    spark_done = time.time()
    con.execute(f"CREATE OR REPLACE TEMP TABLE duck_side AS {sql}")
    duck_columns = sorted(r[0] for r in con.execute("DESCRIBE duck_side").fetchall())
    return columns, duck_columns


def compare(spark_df, con, sql) -> str:
    """Empty when the results are equal as multisets, else what differs."""
    columns, duck_columns = rows_of(spark_df, con, sql)
    if columns != duck_columns:
        return f"columns {columns} / {duck_columns}"
    spark_types = dict(r[:2] for r in con.execute("DESCRIBE spark_side").fetchall())
    duck_types = dict(r[:2] for r in con.execute("DESCRIBE duck_side").fetchall())
    if spark_types != duck_types:
        return f"types {[(c, spark_types[c], duck_types[c]) for c in columns if spark_types[c] != duck_types[c]]}"
    picked = ", ".join(f'"{c}"' for c in columns)
    counts = [con.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in ("spark_side", "duck_side")]
    extra = con.execute(
        f"SELECT {picked} FROM spark_side EXCEPT ALL SELECT {picked} FROM duck_side LIMIT 3").fetchall()
    lacking = con.execute(
        f"SELECT {picked} FROM duck_side EXCEPT ALL SELECT {picked} FROM spark_side LIMIT 3").fetchall()
    if extra or lacking or counts[0] != counts[1]:
        return f"rows {counts} extra {extra} lacking {lacking}"
    return ""


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as entry

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.001"), sys.argv[2:]
    spark = make_session()
    sf_dir = f"{DATA}/sf{sf}"
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, con, oracle[name]) if name in oracle else f"no SQL; {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            globals()["spark_done"] = time.time()
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{name:28s} {spark_done - start:6.1f}s {time.time() - spark_done:6.1f}s  {problem or 'equal'}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
