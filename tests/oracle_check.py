"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [slug ...]
Prints one line per query: OK / MISMATCH (rows, schema, values) / ERROR.
"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE",
            "smallint": "SMALLINT", "float": "FLOAT", "tinyint": "TINYINT"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _canon(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0   # -0.0 -> 0.0
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "item"):
        try:
            return _canon(v.item())
        except Exception:
            return v
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    return v


def _rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_canon(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(sdf, con, sql):
    spark_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_pdf = sdf.toPandas()
    rel = con.sql(sql)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    d_pdf = rel.df()
    problems = []
    if sorted(s_pdf.columns) != sorted(d_pdf.columns):
        return [f"columns spark={sorted(s_pdf.columns)} duck={sorted(d_pdf.columns)}"]
    for c in s_pdf.columns:
        st = TYPE_MAP.get(spark_types[c], spark_types[c])
        if st != d_types[c]:
            problems.append(f"type {c}: spark={spark_types[c]} duck={d_types[c]}")
    if len(s_pdf) != len(d_pdf):
        problems.append(f"rows spark={len(s_pdf)} duck={len(d_pdf)}")
        return problems
    cols, a = _rows(s_pdf)
    _, b = _rows(d_pdf)
    bad = 0
    first = None
    for ra, rb in zip(a, b):
        for c, x, y in zip(cols, ra, rb):
            same = x == y or (isinstance(x, float) and isinstance(y, float)
                              and abs(x - y) <= 1e-9 * max(1.0, abs(x)))
            if not same:
                bad += 1
                if first is None:
                    first = (c, x, y)
    if bad:
        problems.append(f"values: {bad} cells differ, first {first}")
    return problems


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = argv[2:]
    from netwarden.session import build_session
    import __spark_entry__ as E
    spark = build_session()
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    n_ok = n_bad = 0
    for slug in (only or sorted(q)):
        if slug not in o:
            if os.environ.get("ORACLE_ONLY"):
                continue
            t = time.time()
            try:
                n = q[slug](spark, sf_dir).count()
                print(f"ROWS-ONLY {slug}: {n} rows ({time.time()-t:.1f}s)")
            except Exception as e:  # noqa: BLE001
                n_bad += 1
                print(f"ERROR {slug}: {type(e).__name__}: {str(e)[:300]}")
            continue
        t = time.time()
        try:
            probs = compare(q[slug](spark, sf_dir), con, o[slug])
        except Exception as e:  # noqa: BLE001
            n_bad += 1
            print(f"ERROR {slug}: {type(e).__name__}: {str(e)[:400]}")
            continue
        if probs:
            n_bad += 1
            print(f"MISMATCH {slug}: {probs}")
        else:
            n_ok += 1
            print(f"OK {slug} ({time.time()-t:.1f}s)")
    print(f"summary ok={n_ok} bad={n_bad} rows_only={len([s for s in (only or q) if s not in o])}")
    return 1 if n_bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
