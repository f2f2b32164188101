"""Run queries against DuckDB on the same parquet files: ``python -m tests.oracle [names]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    return a == b


def rows_of(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, [tuple(_norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]


def _kind(v):
    return None if v is None else type(v).__name__


def compare(got, want) -> str:
    """Empty string when equal, a message otherwise."""
    (gc, gr), (wc, wr) = got, want
    if gc != wc:
        return f"columns differ: {gc} vs {wc}"
    if len(gr) != len(wr):
        return f"row count {len(gr)} vs {len(wr)}"
    for i, name in enumerate(gc):
        a = {_kind(r[i]) for r in gr} - {None}
        b = {_kind(r[i]) for r in wr} - {None}
        if a != b:
            return f"types of {name} differ: {a} vs {b}"
    if Counter(gr) == Counter(wr):
        return ""
    key = lambda r: tuple((v is None, repr(round(v, 3)) if isinstance(v, float) else repr(v)) for v in r)
    pairs = list(zip(sorted(gr, key=key), sorted(wr, key=key)))
    bad = [(a, b) for a, b in pairs if not all(_close(x, y) for x, y in zip(a, b))]
    if not bad:
        return "values equal only within 1e-9 (round both sides)"
    return f"{len(bad)} rows differ, e.g. {gc}\n   {str(bad[0][0])[:600]}\n   {str(bad[0][1])[:600]}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    spark, con = session(), connect()
    qs, sqls = queries(), oracle_sql()
    names = [n for n in qs if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    failed = []
    for n in names:
        t0 = time.time()
        try:
            got = rows_of(qs[n](spark, SF_DIR))
            msg = compare(got, rows_of_sql(con, sqls[n])) if n in sqls else ""
            if not msg and not got[1]:
                msg = "no rows"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:900]}"
            got = ([], [])
        state = "FAIL" if msg else ("ok" if n in sqls else "rows-only")
        if msg:
            failed.append(n)
        print(f"{state:9s} {n:26s} rows={len(got[1]):<7d} {time.time() - t0:6.1f}s {msg}", flush=True)
    missing = sorted(set(sqls) - set(qs))
    print(f"{len(names)} queries, {len(failed)} failed {failed} oracle without query {missing}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
