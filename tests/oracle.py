"""Run registered queries against their SQL statement; usable as a script.

    python tests/oracle.py [sf_dir] [name ...]
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
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if v is None or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(normal(x) for x in v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(table):
    cols = sorted(table.column_names)
    data = [[normal(x) for x in table.column(c).to_pylist()] for c in cols]
    return cols, sorted(zip(*data), key=repr) if cols else []


def compare(got, want) -> str | None:
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    if gc != wc:
        return f"columns {gc} <> {wc}"
    if len(gr) != len(wr):
        return f"rows {len(gr)} <> {len(wr)}"
    bad = [(a, b) for a, b in zip(gr, wr) if a != b]
    if bad:
        return f"{len(bad)} of {len(gr)} rows differ in {gc}: {bad[:2]}"
    return None


def types_of(table) -> str:
    return ", ".join(f"{f.name}:{f.type}" for f in sorted(table.schema, key=lambda f: f.name))


def main():
    from pyspark.sql import SparkSession

    from panelspark.queries import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for n in names:
        start = time.time()
        try:
            got = QUERIES[n](spark, sf).toArrow()
            took = time.time() - start
            if n in ORACLES:
                start = time.time()
                want = con.sql(ORACLES[n]).to_arrow_table()
                err = compare(got, want)
                note = f"sql {time.time() - start:.1f}s"
                a, b = types_of(got), types_of(want)
                if a.replace("large_string", "string") != b and os.environ.get("TYPES"):
                    note += f" TYPES {a} <> {b}"
            else:
                err, note = None, f"rows only: {got.num_rows}"
        except Exception as e:  # noqa: BLE001
            took, err, note = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += err is not None
        print(f"{'FAIL' if err else 'ok  '} {n} {took:.1f}s {note} {err or ''}", flush=True)
    print(f"{len(names) - bad} ok, {bad} failed")


if __name__ == "__main__":
    main()
