"""Side-by-side check of a registered Spark query against its DuckDB oracle.

Usage: python -m opsight.plans.check [sf_dir] [key-prefix ...]
Compares sorted column names, row counts and the multiset of rows (floats to 4 places).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from ..sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    return str(v) if not isinstance(v, str) else v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]


def rows_of_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in data]


def _key(t):
    return tuple((0, "") if x is None else (1, repr(x)) for x in t)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols, srows = rows_of_spark(sdf)
    t1 = time.time()
    res = {"key": key, "spark_s": round(t1 - t0, 2), "rows": len(srows)}
    if sql is None:
        res["status"] = "no-oracle"
        return res
    dcols, drows = rows_of_duck(con, sql)
    res["duck_rows"] = len(drows)
    if scols != dcols:
        res["status"] = "SCHEMA"
        res["detail"] = f"spark-only={sorted(set(scols)-set(dcols))} duck-only={sorted(set(dcols)-set(scols))}"
        return res
    a, b = sorted(srows, key=_key), sorted(drows, key=_key)
    if a == b:
        res["status"] = "ok"
    else:
        res["status"] = "VALUES"
        sa, sb = set(map(repr, a)), set(map(repr, b))
        diff_a = [x for x in a if repr(x) not in sb][:3]
        diff_b = [x for x in b if repr(x) not in sa][:3]
        res["detail"] = f"cols={scols}\n spark-only={diff_a}\n duck-only={diff_b}"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    prefixes = [a for a in argv[1:] if not a.startswith("/")]
    from ..session import get_session
    from .registry import load_all

    qs, orc = load_all()
    spark = get_session()
    con = duck(sf_dir)
    bad = 0
    for k, fn in qs.items():
        if prefixes and not any(k.startswith(p) for p in prefixes):
            continue
        try:
            r = compare(spark, con, k, fn, orc.get(k), sf_dir)
        except Exception as e:  # report and continue
            r = {"key": k, "status": "ERROR", "detail": f"{type(e).__name__}: {str(e)[:600]}"}
        bad += r["status"] not in ("ok", "no-oracle")
        print(r, flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
