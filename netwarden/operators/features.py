"""Feature scaling, correlation, selection and assembly."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netwarden.functions.scalar import sql_str


def cast_double(df: DataFrame, names: list[str]) -> DataFrame:
    """Cast the named columns to double in one projection."""
    s = set(names)
    return df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" if c in s else f"`{c}`"
                           for c in df.columns])


def scaler_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """Population mean and std per feature (one aggregate); zero std -> divisor 1.

    Returns (feature, mean, std) — one row per feature.
    """
    aggs = []
    for i, c in enumerate(cols):
        x = f"nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE))"      # NaN counts as missing
        aggs += [f"avg({x}) AS m{i}", f"stddev_pop({x}) AS s{i}"]
    wide = df.selectExpr(*aggs)
    cells = ", ".join(
        f"struct({sql_str(c)} AS feature, m{i} AS mean, "
        f"CASE WHEN s{i} = 0 OR s{i} IS NULL THEN 1.0D ELSE s{i} END AS std)" for i, c in enumerate(cols))
    return wide.selectExpr(*[f"inline(array({cells}))"])


def scaler_params(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """Collect the scaler (one row per feature: bounded by the column count)."""
    return {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}


def scale_features(df: DataFrame, params: dict[str, tuple[float, float]],
                   suffix: str = "") -> DataFrame:
    """(x - mean) / std by column *name*: a subset or a different order works."""
    exprs = {}
    for c, (m, s) in params.items():
        if c in df.columns:
            exprs[f"{c}{suffix}"] = f"(CAST(`{c}` AS DOUBLE) - {float(m)!r}D) / {float(s)!r}D"
    keep = [f"`{c}`" for c in df.columns if c not in exprs]
    return df.selectExpr(*keep + [f"{e} AS `{c}`" for c, e in exprs.items()])


def correlation_matrix(df: DataFrame, cols: list[str], digits: int | None = 6) -> DataFrame:
    """Pearson correlation for each pair i < j (column order), pairwise deletion of NULL and NaN;
    unrounded where ``digits`` is None.

    One scan for any number of columns: a task accumulates the cross products of its batches (k x k
    blocks of pairwise counts, means and centred products) and sends one row per pair, which
    Spark merges around the pair's means. Deviations are taken from a value of the column itself, so
    that a constant column gives exactly zero, hence NULL, not an ANSI error.
    """
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "feature_a string, feature_b string, corr double")
    k = len(cols)
    upper = np.triu_indices(k, 1)

    def run(batches):
        # per pair of columns (i, j): rows with both; means of i and of j over them; centred products ij, ii, jj
        total = None
        pivot = np.full(k, np.nan)
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)])
            for i in np.flatnonzero(np.isnan(pivot)).tolist():
                some = x[~np.isnan(x[:, i]), i]
                pivot[i] = some[0] if len(some) else np.nan
            there = ~np.isnan(x)
            d = np.where(there, x - np.nan_to_num(pivot), 0.0)
            m = there.astype(np.float64)
            n, s = m.T @ m, d.T @ m                         # s[i, j]: sum of i over rows that have j
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(n > 0, s / n, 0.0)
            new = [n, mean, d.T @ d - n * mean * mean.T, (d * d).T @ m - n * mean * mean]
            total = new if total is None else _merged(total, new)
        if total is None:
            return
        n, mean, cross, square = total
        at = np.nan_to_num(pivot)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (upper[0].astype(np.int32), upper[1].astype(np.int32), n[upper],
                                   mean[upper] + at[upper[0]], mean.T[upper] + at[upper[1]],
                                   cross[upper], square[upper], square.T[upper])],
            ["i", "j", "n", "mi", "mj", "c", "vi", "vj"])

    def _merged(a, b):
        n = a[0] + b[0]
        safe = np.where(n > 0, n, 1.0)
        delta = b[1] - a[1]
        weight = a[0] * b[0] / safe
        mean = np.where(a[0] > 0, np.where(b[0] > 0, a[1] + delta * b[0] / safe, a[1]), b[1])
        return [n, mean, a[2] + b[2] + weight * delta * delta.T, a[3] + b[3] + weight * delta * delta]

    vals = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    parts = vals.mapInArrow(run, "i int, j int, n double, mi double, mj double, c double, vi double, vj double").where("n > 0")
    # one row per task and pair, merged around the pair's means (as distances from the least one)
    by = Window.partitionBy("i", "j")
    parts = parts.withColumns({"di": F.col("mi") - F.min("mi").over(by), "dj": F.col("mj") - F.min("mj").over(by)})
    parts = parts.withColumns({m: F.col(m) - F.sum(F.col("n") * F.col(m)).over(by) / F.sum("n").over(by) for m in ("di", "dj")})
    merged = parts.groupBy("i", "j").agg(
        (F.sum("c") + F.sum(F.col("n") * F.col("di") * F.col("dj"))).alias("c"),
        (F.sum("vi") + F.sum(F.col("n") * F.col("di") * F.col("di"))).alias("vi"),
        (F.sum("vj") + F.sum(F.col("n") * F.col("dj") * F.col("dj"))).alias("vj"))
    names = F.array(*[F.lit(c) for c in cols])
    corr = F.try_divide(F.col("c"), F.sqrt(F.col("vi") * F.col("vj")))
    every = spark.range(k * k).selectExpr(f"CAST(id DIV {k} AS INT) AS i", f"CAST(id % {k} AS INT) AS j").where("i < j")
    return every.join(merged, ["i", "j"], "left").select(
        names[F.col("i")].alias("feature_a"), names[F.col("j")].alias("feature_b"),
        (corr if digits is None else F.round(corr, digits)).alias("corr"))


def correlated_to_drop(df: DataFrame, cols: list[str], threshold: float = 0.95) -> list[str]:
    """Column j is dropped if any earlier column has |corr| > threshold (not greedy)."""
    rows = correlation_matrix(df, cols, digits=None).collect()  # k(k-1)/2 numbers
    drop = {r["feature_b"] for r in rows if r["corr"] is not None and abs(r["corr"]) > threshold}
    return [c for c in cols if c in drop]


def drop_correlated(df: DataFrame, cols: list[str], threshold: float = 0.95) -> DataFrame:
    return df.drop(*correlated_to_drop(df, cols, threshold))


def select_top_features(df: DataFrame, ranked: list[str], top_n: int = 20,
                        keep=("row_id", "label")) -> DataFrame:
    """Keep the ``top_n`` best features in importance order; unknown names are skipped."""
    top = [f for f in ranked[:top_n] if f in df.columns]
    return df.select(*[k for k in keep if k in df.columns], *top)


def default_features(df: DataFrame, feature_names: list[str]) -> DataFrame:
    """Absent feature -> 0.0, NULL -> 0.0; extra columns are left untouched."""
    exprs = {f: (f"coalesce(CAST(`{f}` AS DOUBLE), 0.0D)" if f in df.columns else "0.0D")
             for f in feature_names}
    keep = [f"`{c}`" for c in df.columns if c not in exprs]
    return df.selectExpr(*keep + [f"{e} AS `{c}`" for c, e in exprs.items()])


def to_feature_vector(df: DataFrame, feature_names: list[str], out_col: str = "features") -> DataFrame:
    """All features as double, in the given order, into one ML vector column."""
    cast = cast_double(df, feature_names)
    return VectorAssembler(inputCols=feature_names, outputCol=out_col, handleInvalid="keep").transform(cast)
