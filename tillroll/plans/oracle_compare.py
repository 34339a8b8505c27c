"""Local twin of the driver's correctness check: run a registered query in
Spark and its SQL in DuckDB on the same parquet files, then compare row
count, column names and an order-insensitive hash of normalised values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _digest(rows):
    hs = sorted(hashlib.sha1(repr(r).encode()).hexdigest() for r in rows)
    return hashlib.sha1("".join(hs).encode()).hexdigest()


def compare(spark, con, name, spark_fn, sql, sf_dir):
    sdf = spark_fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    out = {"name": name, "spark_rows": len(srows), "oracle_rows": len(drows),
           "cols_match": sorted(scols) == sorted(dcols)}
    if not out["cols_match"]:
        out["spark_cols"], out["oracle_cols"] = scols, dcols
        out["ok"] = False
        return out
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    sn = [tuple(_norm(r[i]) for i in si) for r in srows]
    dn = [tuple(_norm(r[i]) for i in di) for r in drows]
    out["hash_match"] = _digest(sn) == _digest(dn)
    out["ok"] = out["hash_match"] and len(srows) == len(drows)
    if not out["ok"]:
        ss, ds = sorted(map(repr, sn)), sorted(map(repr, dn))
        only_s = sorted(set(ss) - set(ds))[:3]
        only_d = sorted(set(ds) - set(ss))[:3]
        out["cols"] = order
        out["only_spark"], out["only_oracle"] = only_s, only_d
    return out
