"""Run named queries on Spark and their SQL on DuckDB, and compare whole results.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks import inputs
from checks.queries import ORACLE, QUERIES


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("checks")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in inputs.BASE_TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "<null>"
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    out = QUERIES[name](spark, sf_dir)
    got = normal(pd.DataFrame([r.asDict() for r in out.collect()], columns=out.columns).astype(object))
    took = time.time() - start
    if name not in ORACLE:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    start = time.time()
    rel = con.sql(ORACLE[name])
    rows = rel.fetchall()
    want = normal(pd.DataFrame(rows, columns=rel.columns).astype(object))
    note = f"{len(got)} rows, {took:.1f}s / {time.time() - start:.1f}s"
    if sorted(out.columns) != sorted(rel.columns):
        return False, f"columns {sorted(out.columns)} vs {sorted(rel.columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return False, f"{note}; {len(want)} wanted\n   spark only {extra}\n   sql only {lack}"
    return True, note


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as err:
            ok, note = False, f"{type(err).__name__}: {str(err)[:600]}"
        bad += not ok
        print(("ok   " if ok else "DIFF ") + name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
