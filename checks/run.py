"""Run registered queries against their twins: ``python -m checks.run [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import checks
from linkloom.session import BUILD_SETTINGS

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("checks")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config(map=BUILD_SETTINGS).getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def main(names: list[str]) -> int:
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in names or sorted(checks.QUERIES):
        started = time.time()
        try:
            df = checks.QUERIES[name](spark, sf)
            cols = sorted(df.columns)
            mine = [tuple(cell(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - started
        if name not in checks.TWINS:
            print(f"rows {name}: {len(mine)} rows, {took:.1f}s", flush=True)
            continue
        try:
            started = time.time()
            cur = con.execute(checks.TWINS[name])
            their_cols = [c[0] for c in cur.description]
            order = [their_cols.index(c) for c in cols]
            theirs = [tuple(cell(r[i]) for i in order) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: twin: {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        a, b = sorted(map(repr, mine)), sorted(map(repr, theirs))
        if a == b and len(their_cols) == len(cols):
            print(f"ok   {name}: {len(a)} rows, {took:.1f}s / {time.time() - started:.1f}s",
                  flush=True)
        else:
            bad += 1
            only_a = sorted(set(a) - set(b))[:4]
            only_b = sorted(set(b) - set(a))[:4]
            print(f"DIFF {name}: {len(a)} vs {len(b)} rows\n  cols {cols}\n  spark {only_a}\n  duck  {only_b}",
                  flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
