"""Run registered queries and their SQL side by side: `python -m checks.compare [sf] [query ...]`."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import REGISTRY

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return round(v, 9)
    return str(v) if not isinstance(v, str) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sf: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), _rows(names, cur.fetchall())


def spark_rows(spark, sf: str, name: str):
    df = REGISTRY[name](spark, sf)
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def differences(spark, sf: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    got_names, got = spark_rows(spark, sf, name)
    want_names, want = oracle_rows(sf, ORACLE[name])
    if got_names != want_names:
        return f"columns {got_names} <> {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}; first extra {(set(map(repr, got)) ^ set(map(repr, want))).pop()}"
    for a, b in zip(got, want):
        if a != b:
            return f"{dict(zip(got_names, a))} <> {dict(zip(want_names, b))}"
    return None


def main() -> None:
    from tallyhound.session import build_session
    sf = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in sys.argv[2:] or list(REGISTRY):
        began = time.time()
        if name not in ORACLE:
            print(f"{name}: no SQL")
            continue
        try:
            problem = differences(spark, sf, name)
        except Exception as ex:
            problem = str(ex)[:1500]
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print("differences:", bad)


if __name__ == "__main__":
    main()
