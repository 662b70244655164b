"""Equal-width histograms and Gaussian KDE per class, as aggregate plans.

Per-class bounds come from one small aggregate (one row per class).  The
class table is broadcast only after its size is checked; rows are then binned
by a column expression and counted with partial aggregation, so a class that
holds most rows never lands in one task.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from netwarden.sources.local import local_table

MAX_BROADCAST_GROUPS = 100_000


def bounded_local(small: DataFrame, limit: int = MAX_BROADCAST_GROUPS) -> DataFrame | None:
    """Fetch at most ``limit + 1`` rows; a local copy if the table fits, else None.

    One job, and the join that follows reads the local copy instead of
    recomputing the small table's plan."""
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return local_table(small.sparkSession, rows, small.schema)


def attach_small(df: DataFrame, small: DataFrame, on, limit: int = MAX_BROADCAST_GROUPS,
                 how: str = "inner") -> DataFrame:
    """Join a per-group table: broadcast when its size is within ``limit``, else shuffle."""
    local = bounded_local(small, limit)
    side = F.broadcast(local) if local is not None else small
    return df.join(side, on, how)


def histogram_by_class(df: DataFrame, value_col: str, class_col: str, bins: int = 40,
                       density: bool = True) -> DataFrame:
    """``bins`` equal bins over each class's own [min, max]; the maximum joins the last bin.

    A constant class uses [v - 0.5, v + 0.5].  Empty bins are not listed.
    """
    x = F.col(value_col)
    clean = df.where(x.isNotNull() & ~F.isnan(x) & F.col(class_col).isNotNull())
    stats = clean.groupBy(class_col).agg(F.min(x).alias("_lo0"), F.max(x).alias("_hi0"),
                                         F.count(F.lit(1)).alias("_n"))
    same = F.col("_hi0") == F.col("_lo0")
    stats = stats.select(
        class_col, "_n",
        F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
        F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    stats = stats.withColumn("_w", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
    j = attach_small(clean.select(class_col, x.alias("_x")), stats, class_col)
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.col("_w")).cast("int"), F.lit(bins - 1))
    counts = j.groupBy(class_col, b.alias("bin"), "_lo", "_w", "_n").agg(
        F.count(F.lit(1)).alias("n"))
    cols = [class_col, "bin",
            F.round(F.col("_lo") + F.col("bin") * F.col("_w"), 6).alias("bin_lo"),
            F.round(F.col("_lo") + (F.col("bin") + 1) * F.col("_w"), 6).alias("bin_hi"), "n"]
    if density:
        cols.append(F.round(F.col("n") / (F.col("_n") * F.col("_w")), 6).alias("density"))
    return counts.select(*cols)


def kde_by_class(df: DataFrame, value_col: str, class_col: str, points: int = 300,
                 prebin: int | None = None) -> DataFrame:
    """Gaussian KDE of each class on ``points`` grid points spanning the overall range.

    Bandwidth: Scott's rule, ``h = stddev_samp * n ** (-1/5)``.  Rows are
    first collapsed to (class, value, weight), which keeps the work exact and
    bounded by distinct values; a task sums their kernels over the fixed grid in
    arrays and sends one row per class and point, whatever its number of values.

    ``prebin`` (e.g. 10_000) snaps values to that many equal bins over the
    overall range before collapsing: the work becomes bounded by
    ``classes x prebin x points`` whatever the row count, at a small,
    controlled approximation (bandwidths still use the raw values).
    """
    x = F.col(value_col)
    clean = df.where(x.isNotNull() & ~F.isnan(x) & F.col(class_col).isNotNull()).select(
        class_col, x.alias("_x"))
    rng = clean.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    if rng["lo"] is None:
        return df.sparkSession.createDataFrame(
            [], f"{class_col} {dict(df.dtypes)[class_col]}, point int, x double, density double")
    lo, hi = float(rng["lo"]), float(rng["hi"])
    step = (hi - lo) / (points - 1)
    grid = [hi if j == points - 1 else lo + j * step for j in range(points)]

    snapped = clean
    if prebin and hi > lo:
        width = (hi - lo) / prebin
        idx = F.least(F.floor((F.col("_x") - F.lit(lo)) / F.lit(width)), F.lit(prebin - 1))
        snapped = clean.withColumn("_x", F.lit(lo) + (idx + F.lit(0.5)) * F.lit(width))
    weighted = snapped.groupBy(class_col, "_x").agg(F.count(F.lit(1)).alias("_w"))
    stats = clean.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n"),
                                         F.stddev_samp("_x").alias("_sd"))
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    j = attach_small(weighted, stats.select(class_col, "_n", "_h"), class_col)
    at = np.array(grid)

    def sums(batches):
        # density sums of every class over the grid; one row per class and point leaves a task
        total: dict = {}

        def out():
            names = [c for c in total for _ in range(points)]
            return pa.RecordBatch.from_arrays(
                [pa.array(names, kind), pa.array(np.tile(np.arange(points, dtype=np.int32), len(total))),
                 pa.array(np.concatenate([v[0] for v in total.values()])),
                 pa.array(np.repeat([v[1] for v in total.values()], points))], ["_c", "point", "_s", "_norm"])

        kind = None
        for b in batches:
            kind = b.column("_c").type
            classes = b.column("_c").dictionary_encode()
            of = classes.indices.to_numpy(zero_copy_only=False)
            x, w, n, h = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_x", "_w", "_n", "_h"))
            for k, name in enumerate(classes.dictionary.to_pylist()):
                rows = np.flatnonzero((of == k) & (h > 0))
                for lo in range(0, len(rows), 4096):
                    some = rows[lo:lo + 4096]
                    z = (at[None, :] - x[some, None]) / h[some, None]
                    v = total.setdefault(name, [np.zeros(points), n[some[0]] * h[some[0]] * root])
                    v[0] += w[some] @ np.exp(-0.5 * z * z)
                if not len(rows):                                  # one value only: no bandwidth
                    total.setdefault(name, [np.zeros(points), float("nan")])
            if len(total) > 1000:
                yield out()
                total = {}
        if total:
            yield out()

    root = math.sqrt(2.0 * math.pi)
    ctype = dict(df.dtypes)[class_col]
    part = j.select(F.col(class_col).alias("_c"), F.col("_x").cast("double").alias("_x"), "_w", "_n", "_h").mapInArrow(
        sums, f"_c {ctype}, point int, _s double, _norm double")
    summed = part.groupBy("_c", "point").agg(F.sum("_s").alias("_s"), F.max("_norm").alias("_norm"))
    xs = F.array(*[F.lit(g) for g in grid])
    density = F.when(~F.isnan("_norm"), F.try_divide(F.col("_s"), F.col("_norm")))
    return summed.select(F.col("_c").alias(class_col), "point", xs[F.col("point")].alias("x"), F.round(density, 6).alias("density"))
