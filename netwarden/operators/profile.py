"""Dataset profile: shape, types, nulls, class balance."""
from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from netwarden.sources.local import local_table


def numeric_columns(df: DataFrame, exclude=(), first_n: int | None = None) -> list[str]:
    """Numeric columns in schema order (Boolean is not numeric)."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]
    return cols[:first_n] if first_n else cols


def select_numeric(df: DataFrame, exclude=(), first_n: int | None = None) -> DataFrame:
    return df.select(*numeric_columns(df, exclude, first_n))


def profile_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("int"))


def profile_dtypes(df: DataFrame) -> DataFrame:
    """Number of columns per type: schema only, no job."""
    counts = Counter(t for _, t in df.dtypes)
    return local_table(df.sparkSession, sorted(counts.items()), "dtype string, n_columns int")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One pass: NULL (and NaN for floating columns) cells per column, as rows."""
    cols = columns or df.columns
    kinds = dict(df.dtypes)

    def missing(c):
        cond = F.col(c).isNull()
        if kinds[c] in ("double", "float"):
            cond = cond | F.isnan(c)
        return F.count_if(cond)

    wide = df.agg(*[missing(c).alias(c) for c in cols])
    stacked = wide.unpivot([], cols, "column_name", "n_missing")
    return stacked.select("column_name", F.col("n_missing").cast("long"))


def profile_nulls(df: DataFrame, top: int = 10) -> DataFrame:
    """Top ``top`` columns by missing count (ties by name)."""
    return null_counts(df).orderBy(F.col("n_missing").desc(), "column_name").limit(top)


def total_nulls(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("n_missing").cast("long").alias("total_missing"))


def class_distribution(df: DataFrame, label_col: str = "label", classes=(0, 1)) -> DataFrame:
    """Count and share (%) per class; classes absent from the data report 0. Shares are taken
    against a one-row total inside the plan, for any number of classes."""
    label = F.col(label_col)
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    asked = local_table(df.sparkSession, [(c, 0) for c in classes], f"{label_col} int, n long") \
        .select(label.cast(df.schema[label_col].dataType).alias(label_col), "n")
    full = counts.unionByName(asked).groupBy(label_col).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").cast("double")).scalar()
    return full.select(label_col, "n", F.round(F.try_divide(F.col("n") * 100.0, total), 6).alias("pct"))


def filter_class(df: DataFrame, label_col: str, value, drop_missing: list[str] | None = None) -> DataFrame:
    """Rows of one class; optionally drop rows missing any of ``drop_missing``."""
    out = df.where(F.col(label_col) == F.lit(value))
    for c in drop_missing or []:
        out = out.where(F.col(c).isNotNull())
        if dict(df.dtypes)[c] in ("double", "float"):
            out = out.where(~F.isnan(c))
    return out
