"""Cleaning operators: labels, infinities, missing values, codes, duplicates."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.operators.ordered import ordered_running
from netwarden.operators.profile import numeric_columns
from netwarden.operators.quantiles import exact_percentiles
from netwarden.schema import BENIGN_LABEL
from netwarden.session import checkpoint_dir


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any job runs if a required column is absent."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"required column(s) missing: {missing}")
    return df


def normalize_labels(df: DataFrame, raw_col: str = "Label") -> DataFrame:
    """Raw string label -> ``label`` (BENIGN = 0, anything else incl. missing = 1)
    and ``attack_type`` = raw text; the raw column is dropped."""
    require_columns(df, raw_col)
    raw = F.col(raw_col)
    # One projection: column names resolve case-insensitively, so ``label``
    # must not be created while ``Label`` is still in scope.
    others = [F.col(c) for c in df.columns if c != raw_col and c.lower() not in ("label", "attack_type")]
    return df.select(*others,
                     (~raw.eqNullSafe(F.lit(BENIGN_LABEL))).cast("int").alias("label"),
                     raw.cast("string").alias("attack_type"))


def split_features_label(df: DataFrame, label_col: str = "label",
                         drop=("attack_type",), keep=("row_id",)) -> DataFrame:
    """Features + integer label; metadata columns dropped (absent names ignored)."""
    require_columns(df, label_col)
    out = df.drop(*[c for c in drop if c not in keep])
    return out.withColumn(label_col, F.col(label_col).cast("int"))


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def inf_count(df: DataFrame) -> DataFrame:
    """Number of +-Inf cells over all floating columns (one aggregate)."""
    cols = float_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([(0,)], "n_infinite long")
    terms = [F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))) for c in cols]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.agg(total.cast("long").alias("n_infinite"))


def inf_to_null(df: DataFrame) -> DataFrame:
    """+-Inf and NaN -> NULL in every floating column."""
    cols = set(float_columns(df))
    if not cols:
        return df
    return df.selectExpr(*[
        f"CASE WHEN isnan(`{c}`) OR abs(`{c}`) = double('Infinity') THEN NULL ELSE `{c}` END AS `{c}`"
        if c in cols else f"`{c}`" for c in df.columns])


def median_impute(df: DataFrame, columns: list[str] | None = None, exact: bool = True,
                  exclude=("row_id", "label")) -> DataFrame:
    """Numeric NULLs <- the column median (computed over the given rows).

    Only columns that actually hold NULLs are filled (one counting pass
    finds them); filled columns become double, as a column median may fall
    between integers.  All-NULL columns stay NULL; strings are not filled.
    ``exact=False`` uses ``percentile_approx``.
    """
    cols = columns or numeric_columns(df, exclude=exclude)
    if not cols:
        return df
    row = df.selectExpr(*[f"count_if(`{c}` IS NULL) AS `n_{c}`" for c in cols]).first()
    gaps = [c for c in cols if row[f"n_{c}"] > 0]
    if not gaps:
        return df
    if exact:
        med = exact_percentiles(df, gaps, 0.5)
    else:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c)
                       for c in gaps]).first().asDict()
        med = {c: (None if row[c] is None else float(row[c])) for c in gaps}
    return fill_values(df, {c: med[c] for c in gaps})


def fill_values(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """NULLs of the named columns (cast to double) <- their value; a column without one stays NULL."""
    fills = {}
    for c, v in values.items():
        x = f"CAST(`{c}` AS DOUBLE)"
        fills[c] = x if v is None else f"coalesce({x}, {float(v)!r}D)"
    return df.selectExpr(*[f"{fills[c]} AS `{c}`" if c in fills else f"`{c}`" for c in df.columns])


def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]


def code_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, code: the distinct non-null values of all columns, numbered from 0 in sorted
    (binary) order within their column.

    One stacked table for any number of columns: copies collapse map-side, one
    distributed running number orders it, and the number of a column's first value is taken
    off (one row per column)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    values = df.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    ranked = ordered_running(values, [F.col("column"), F.col("value")], rn_col="_rn")
    first = ranked.groupBy("column").agg(F.min("_rn").alias("_first"))
    return ranked.join(first, "column").select("column", "value", (F.col("_rn") - F.col("_first")).cast("int").alias("code"))


def apply_codes(df: DataFrame, dictionary: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """Each column -> its value's code; a missing value, or one that the dictionary lacks, -> -1. The plan
    broadcasts a column's part of the dictionary where its size allows it, and shuffles otherwise."""
    out = df
    for c in columns:
        side = dictionary.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        out = out.join(side, F.col(f"`{c}`").cast("string") == F.col("_value"), "left") \
            .withColumn(f"{c}{suffix}", F.coalesce(F.col("_code"), F.lit(-1)).cast("int")).drop("_value", "_code")
    return out


def categorical_codes(df: DataFrame, columns: list[str] | None = None,
                      suffix: str = "") -> DataFrame:
    """Each string column -> its code in sorted order; missing -> -1."""
    cols = columns if columns is not None else string_columns(df)
    if not cols:
        return df
    checkpoint_dir(df.sparkSession)
    return apply_codes(df, code_dictionary(df, cols).checkpoint(eager=True), cols, suffix)


@dataclass
class Preparation:
    """What cleaning learned from the rows it was fitted on, to be replayed on others: the median of
    every numeric column, and the code dictionary of the text columns (column, value, code)."""
    medians: dict[str, float | None] = field(default_factory=dict)
    text: list[str] = field(default_factory=list)
    codes: DataFrame | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Infinities to NULL, NULLs to the medians, texts to their codes (unseen and missing ones -1);
        columns that the fitted rows did not have pass unchanged, absent ones stay absent."""
        x = fill_values(inf_to_null(df), {c: v for c, v in self.medians.items() if c in df.columns})
        text = [c for c in self.text if c in df.columns]
        return apply_codes(x, self.codes, text) if text else x


def fit_preparation(df: DataFrame, exclude=("row_id", "label"), exact: bool = True) -> Preparation:
    """Medians (``percentile_approx`` where not ``exact``) and code dictionaries of all feature columns."""
    clean = inf_to_null(df)
    cols = numeric_columns(clean, exclude=exclude)
    if exact:
        medians = exact_percentiles(clean, cols, 0.5)
    else:
        row = clean.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), 0.5, 10_000).alias(f"m{i}")
                          for i, c in enumerate(cols)]).first() if cols else ()
        medians = {c: None if v is None else float(v) for c, v in zip(cols, row)}
    text = string_columns(clean, exclude=exclude)
    codes = None
    if text:
        checkpoint_dir(df.sparkSession)
        codes = code_dictionary(clean, text).checkpoint(eager=True)
    return Preparation(medians, text, codes)


def dedup_rows(df: DataFrame, feature_cols: list[str], key: str = "row_id",
               label_col: str | None = "label", count_col: str | None = "n_copies") -> DataFrame:
    """Rows equal in every feature collapse to the first one (smallest key) and its label.

    NULL equals NULL for grouping.  Partial aggregation collapses copies
    map-side, so a group holding a third of all rows never moves whole.
    """
    aggs = [F.min(key).alias(key)]
    if label_col:
        aggs.append(F.min_by(label_col, key).alias(label_col))
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    return df.groupBy(*feature_cols).agg(*aggs)
