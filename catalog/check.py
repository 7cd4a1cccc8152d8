"""Run registered queries and compare them with their SQL on the same files.

    python -m catalog.check [--sf DIR] [names...]
"""

from __future__ import annotations

import argparse
import time

import duckdb
import pandas as pd

from presswork.session import get_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    if not len(df):
        return df
    return df.sort_values(list(df.columns), kind="stable", na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    got, want = canonical(got), canonical(want)
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} / {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    for c in got.columns:
        a, b = got[c], want[c]
        if str(a.dtype) != str(b.dtype) and not (a.dtype == object or b.dtype == object):
            return f"type of {c}: {a.dtype} / {b.dtype}"
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} of {len(a)} differ in {c}: {a[i]!r} / {b[i]!r} in {got.loc[i].to_dict()}"[:1500]
    return None


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--fast", action="store_true", help="do not run the SQL")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    from catalog.oracles import ORACLES
    from catalog.queries import REGISTRY

    spark = get_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    bad = []
    for name in args.names or REGISTRY:
        t = time.time()
        try:
            got = REGISTRY[name](spark, args.sf).toPandas()
        except Exception as e:  # report and go on
            bad.append(name)
            print(f"ERR   {name}: {str(e)[:1200]}", flush=True)
            continue
        took = time.time() - t
        if name not in ORACLES or args.fast:
            print(f"rows  {name}: {len(got)} in {took:.1f}s {list(got.columns)}", flush=True)
            continue
        t = time.time()
        try:
            want = con.execute(ORACLES[name]).df()
        except Exception as e:
            bad.append(name)
            print(f"SQL   {name}: {str(e)[:900]}", flush=True)
            continue
        diff = difference(got, want)
        if diff:
            bad.append(name)
        print(f"{'DIFF ' if diff else 'ok   '} {name}: {diff or len(got)} ({took:.1f}s, sql {time.time() - t:.1f}s)", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
