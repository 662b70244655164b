"""Small driver-side tables (dimensions, offsets, per-class statistics) as SQL
``VALUES`` relations: planned and run inside the JVM, no Python worker.

Callers pass only bounded row lists (a fixed dimension or a fetch whose size
was checked); beyond ``max_inline`` rows ``createDataFrame`` is used.
"""
from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_INLINE = 5_000


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "CAST('NaN' AS DOUBLE)"
        if math.isinf(v):
            return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
        return f"{v!r}D"
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(v, dt.date):
        return f"DATE '{v.isoformat()}'"
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def local_table(spark: SparkSession, rows: list, schema) -> DataFrame:
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if not rows or len(rows) > MAX_INLINE:
        return spark.createDataFrame(rows, st)
    n = len(st.fields)
    cols = [f"c{i}" for i in range(n)]
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    proj = ", ".join(f"CAST({c} AS {f.dataType.simpleString()}) AS `{f.name}`"
                     for c, f in zip(cols, st.fields))
    return spark.sql(f"SELECT {proj} FROM VALUES {body} AS t({', '.join(cols)})")

