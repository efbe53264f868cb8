"""Run catalog queries against their SQL on DuckDB: python check_oracles.py [sf_dir] [name prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: str | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]").appName("rareboost")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def compare(spark: SparkSession, con, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    out = fn(spark, sf_dir)
    mine = out.toPandas()
    theirs = con.execute(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return False, f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return False, f"rows {len(mine)} vs {len(theirs)}"
    a, b = canonical(mine), canonical(theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, columns {sorted(mine.columns)}: {bad[:2]}"
    kinds = {c: (str(mine[c].dtype), str(theirs[c].dtype)) for c in mine.columns if str(mine[c].dtype) != str(theirs[c].dtype)}
    return True, f"{len(a)} rows" + (f" dtypes {kinds}" if kinds else "")


def main() -> int:
    from rareboost.plans.catalog import ORACLES, QUERIES

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    spark, con = session(), duck(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                ok, note = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
            else:
                n = len(QUERIES[name](spark, sf_dir).toPandas())
                ok, note = n > 0, f"{n} rows, no SQL"
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} passed; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
