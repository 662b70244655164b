"""Exact percentiles by radix selection.

Spark's exact ``percentile``/``median`` keeps every distinct value of a group in one
buffer, which does not survive a global median over billions of continuous values.
Here a double is read as an unsigned 64-bit integer of the same order (sign bit
flipped, negative numbers inverted) and an order statistic is found digit by
digit, sixteen bits a round: a task counts the next digit of the values that share a
wanted prefix, the counts are summed by Spark, and a running sum over at most 65,536
digits per prefix finds the digit that holds the rank. After four rounds the prefix is
the value. All columns and ranks go through the same rounds, at every input size; only one
row per wanted rank reaches the driver. Results equal the interpolating
definition used by ``median`` (and DuckDB).
"""
from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS, ROUNDS = 16, 4
DIGITS = 1 << BITS
#: Columns counted in one job: a task holds DIGITS counters of each wanted prefix.
COLUMNS = 64


def _value(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return struct.unpack("<d", struct.pack("<Q", raw))[0]


def _digit_counts(vals: DataFrame, wanted: list[tuple[int, int]], done: int) -> DataFrame:
    """w, digit, n: for each wanted (column place, prefix of ``done`` bits) how many values have each next digit."""
    shift, digits, sign = np.uint64(64 - done - BITS), DIGITS, np.uint64(1 << 63)

    def run(batches):
        total = np.zeros((len(wanted), digits), np.int64)
        for b in batches:
            keys: dict[int, np.ndarray] = {}
            for w, (c, prefix) in enumerate(wanted):
                if c not in keys:
                    x = b.column(c).drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
                    u = (x[~np.isnan(x)] + 0.0).view(np.uint64)          # -0.0 equals 0.0
                    keys[c] = np.where(u & sign, ~u, u | sign)
                k = keys[c]
                if done:
                    k = k[k >> np.uint64(64 - done) == np.uint64(prefix)]
                digit = (k >> shift) & np.uint64(digits - 1)
                total[w] += np.bincount(digit.astype(np.int64), minlength=digits)
        w, digit = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(w, pa.int64()), pa.array(digit, pa.int64()), pa.array(total[w, digit])], ["w", "digit", "n"])

    return vals.mapInArrow(run, "w bigint, digit bigint, n bigint").groupBy("w", "digit").agg(F.sum("n").alias("n"))


def exact_percentiles(df: DataFrame, cols: list[str], q: float = 0.5) -> dict:
    """{column: interpolated q-quantile or None} for each column (NULL/NaN ignored)."""
    out: dict = {}
    for k in range(0, len(cols), COLUMNS):
        out |= _percentiles(df, cols[k:k + COLUMNS], q)
    return out


def _percentiles(df: DataFrame, cols: list[str], q: float) -> dict:
    vals = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    # wanted: place of the prefix -> (column, prefix); ranks: (column, which) -> (place of its prefix, rank within it)
    wanted = [(i, 0) for i in range(len(cols))]
    ranks: dict[tuple[int, str], tuple[int, int | None]] = {(i, side): (i, None) for i in range(len(cols)) for side in ("lo", "hi")}
    size: dict[int, int] = {}
    for step in range(ROUNDS):
        counts = _digit_counts(vals, wanted, step * BITS)
        by = Window.partitionBy("w")                       # at most DIGITS rows each
        counts = counts.withColumns({"upto": F.sum("n").over(by.orderBy("digit")), "total": F.sum("n").over(by)})
        if step == 0:                                      # the ranks follow from the number of values
            pos = F.lit(float(q)) * (F.col("total") - 1)
            targets = counts.select("*", F.explode(F.array(
                F.struct(F.lit("lo").alias("side"), F.floor(pos).alias("rank")),
                F.struct(F.lit("hi").alias("side"), F.ceil(pos).alias("rank")))).alias("t")).select(
                    "w", "digit", "n", "upto", "total", F.col("t.side").alias("side"), F.col("t.rank").alias("rank"))
            hit = targets.filter("upto > rank AND upto - n <= rank").collect()
            found = {(r.w, r.side): (r.digit, r.rank - (r.upto - r.n)) for r in hit}
            size = {r.w: r.total for r in hit}
        else:
            cases = F.array(*[F.struct(F.lit(w).cast("bigint").alias("tw"), F.lit(i).alias("i"), F.lit(side).alias("side"),
                                       F.lit(rank).cast("bigint").alias("rank")) for (i, side), (w, rank) in ranks.items()])
            hit = counts.select("*", F.explode(F.filter(cases, lambda t: t["tw"] == F.col("w"))).alias("t")) \
                .filter("upto > t.rank AND upto - n <= t.rank") \
                .select("digit", F.col("t.i").alias("i"), F.col("t.side").alias("side"),
                        (F.col("t.rank") - (F.col("upto") - F.col("n"))).alias("rank")).collect()
            found = {(r.i, r.side): (r.digit, r.rank) for r in hit}
        if not found:
            break
        prefix = {key: (wanted[ranks[key][0]][1] << BITS) | digit for key, (digit, _) in found.items()}
        wanted = sorted({(key[0], p) for key, p in prefix.items()})
        ranks = {key: (wanted.index((key[0], prefix[key])), rank) for key, (_, rank) in found.items()}
    out: dict = {c: None for c in cols}
    for i, n in size.items():
        pos = q * (n - 1)
        lo, hi = (_value(wanted[ranks[(i, side)][0]][1]) for side in ("lo", "hi"))
        out[cols[i]] = lo + (pos - math.floor(pos)) * (hi - lo)
    return out


def exact_median(df: DataFrame, cols: list[str]) -> dict:
    return exact_percentiles(df, cols, 0.5)
