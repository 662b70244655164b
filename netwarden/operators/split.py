"""Deterministic sampling and the exact stratified split.

Randomness is ``md5('<seed>:<key>')``: the same in DuckDB, identical on
task retry, and independent of partitioning (``rand()``/``sampleBy`` are not).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netwarden.functions.scalar import hash_unit, md5_key
from netwarden.operators.ordered import ordered_running
from netwarden.schema import SPLIT_SEED, TEST_FRACTION

PREFIX_HEX = 5  # 20-bit bucket of the hash


def sample_n(df: DataFrame, n: int = 5000, key: str = "row_id", seed: int = SPLIT_SEED) -> DataFrame:
    """Exactly min(n, rows) pseudo-random rows: the n smallest ``(md5(seed:key), key)``, a top-n
    in every partition before the final one."""
    return df.orderBy(md5_key(key, seed), F.col(key)).limit(n)


def shuffle_rows(df: DataFrame, key: str = "row_id", seed: int = SPLIT_SEED,
                 position_col: str = "shuffle_pos") -> DataFrame:
    """A seeded permutation, materialised as a 1-based position column."""
    return ordered_running(df, [md5_key(key, seed), F.col(key)], rn_col=position_col)


def stratified_split(df: DataFrame, label_col: str = "label", key: str = "row_id",
                     test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED,
                     split_col: str = "split") -> DataFrame:
    """Exact per-class split: in each class the ``ceil(test_fraction * n_class)`` rows
    with the smallest ``(md5(seed:key), key)`` go to ``test``, the rest to ``train``.

    Plan: count rows per (class, 20-bit hash prefix) — a table of at most
    classes x 2^20 rows, aggregated map-side — and find per class the
    boundary prefix by a running sum over that small table.  Rows off the
    boundary are labelled by a broadcast lookup (one row per class, size
    checked); only rows inside the boundary prefix (about n / 2^20 per class)
    are ranked by a window.  No task ever sees a whole class.
    """
    h = md5_key(key, seed)
    bucket = F.conv(F.substring(h, 1, PREFIX_HEX), 16, 10).cast("int")
    rows = df.withColumns({"_h": h, "_b": bucket})

    counts = rows.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_class = Window.partitionBy(label_col)
    upto = per_class.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({
        "_cum": F.sum("_n").over(upto),
        "_k": F.ceil(F.lit(test_fraction) * F.sum("_n").over(per_class)).cast("long")})
    edge = (counts.where((F.col("_cum") - F.col("_n") < F.col("_k")) & (F.col("_cum") >= F.col("_k")))
            .select(label_col, F.col("_b").alias("_edge"),
                    (F.col("_k") - (F.col("_cum") - F.col("_n"))).alias("_need")))
    # classes with k = 0 have no edge row: every row is train.
    # Null-safe: rows without a label are a class of their own.
    edge = edge.withColumnRenamed(label_col, "_class")
    labelled = rows.join(edge, F.col(label_col).eqNullSafe(F.col("_class")), "left").drop("_class")

    off = labelled.where(F.col("_edge").isNull() | (F.col("_b") != F.col("_edge")))
    off = off.withColumn(split_col, F.when(F.col("_b") < F.col("_edge"), "test").otherwise("train"))
    on = labelled.where(F.col("_b") == F.col("_edge"))
    rank = F.row_number().over(Window.partitionBy(label_col).orderBy("_h", key))
    on = on.withColumn(split_col, F.when(rank <= F.col("_need"), "test").otherwise("train"))
    return off.unionByName(on).drop("_h", "_b", "_edge", "_need")


def attach_small_left(df: DataFrame, small: DataFrame, on: str, limit: int = 100_000) -> DataFrame:
    from netwarden.operators.histograms import attach_small
    return attach_small(df, small, on, limit, how="left")


def hash_split(df: DataFrame, key: str = "row_id", test_fraction: float = TEST_FRACTION,
               seed: int = SPLIT_SEED, split_col: str = "split") -> DataFrame:
    """Approximate split by hash threshold: no shuffle at all (per-row decision)."""
    return df.withColumn(split_col, F.when(hash_unit(key, seed) < F.lit(test_fraction), "test")
                         .otherwise("train"))
