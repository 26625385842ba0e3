"""Compare registered queries with their SQL: ``python tests/compare.py <sf_dir> [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=repr)


def check(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries
    start = time.time()
    df = queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    took = time.time() - start
    if name not in oracle_sql():
        return True, f"rows={len(got)} (no SQL) {took:.1f}s"
    start = time.time()
    res = con.execute(oracle_sql()[name])
    cols = [c[0] for c in res.description]
    want = rows(cols, res.fetchall())
    note = f"rows={len(got)}/{len(want)} {took:.1f}s/{time.time() - start:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return False, f"{note} columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"{note}\n   spark only: {extra}\n   sql only:   {missing}"
    return True, note


def main() -> None:
    from __spark_entry__ import queries
    from veilwork.session import session
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(queries())
    spark = session("local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                   "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = check(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on with the other queries
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad, "of", len(names))


if __name__ == "__main__":
    main()
