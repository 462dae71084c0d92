"""Spark-vs-DuckDB comparison in the manner of the driver's correctness check:
row count, column names (sorted) and an order-insensitive hash of the values."""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (_dt.date,)):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    out = sorted((repr(tuple(_norm(r[i]) for i in order)) for r in rows))
    h = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return names, out, h


def compare(spark, con, name, build, sql, sf_dir):
    sdf = build(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    sn, so, sh = canon(scols, srows)
    dn, do, dh = canon(dcols, drows)
    ok = sn == dn and len(so) == len(do) and sh == dh
    detail = {}
    if not ok:
        detail = {"spark_cols": sn, "duck_cols": dn, "spark_rows": len(so), "duck_rows": len(do),
                  "only_spark": [r for r in so if r not in set(do)][:3],
                  "only_duck": [r for r in do if r not in set(so)][:3]}
    return ok, len(so), detail
