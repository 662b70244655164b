"""The preprocessing chain, in the reference's order:
label -> drop metadata -> inf to NULL -> median fill -> string codes ->
dedup -> stratified split -> scaler fitted on train -> scale by name.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.operators import clean as C
from netwarden.operators import features as FE
from netwarden.operators import split as SP
from netwarden.operators.profile import numeric_columns


@dataclass
class Prepared:
    """``data`` holds raw (cleaned) features, ``label``, ``row_id`` and ``split``."""
    data: DataFrame
    feature_names: list[str]
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)
    preparation: C.Preparation = field(default_factory=C.Preparation)

    def scaled(self) -> DataFrame:
        return FE.scale_features(self.data, self.scaler)

    @property
    def train(self) -> DataFrame:
        return self.scaled().where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.scaled().where(F.col("split") == "test")


CONTEXT_COLUMNS = ("attack_type", "ts", "src_ip", "dst_ip", "port")


#: Prepared rows below which a partition is not worth a task of its own.
ROWS_A_TASK = 4096


def spread(rows: DataFrame) -> DataFrame:
    """A stored table over as many partitions as the session has cores. What comes out of the shuffles is
    merged to a few partitions by its bytes, but training and scoring cost far more a row than reading."""
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // ROWS_A_TASK)
    return rows.repartition(tasks).checkpoint(eager=True) if tasks > rows.rdd.getNumPartitions() else rows


def preprocess(df: DataFrame, key: str = "row_id", label_col: str = "label",
               drop=CONTEXT_COLUMNS, test_fraction: float = 0.25, seed: int = 42,
               exact_median: bool = True, checkpoint: bool = True) -> Prepared:
    C.require_columns(df, label_col, key)
    x = C.split_features_label(df, label_col, drop=drop, keep=(key,))
    fitted = C.fit_preparation(x, exclude=(key, label_col), exact=exact_median)
    x = fitted.apply(x)
    features = numeric_columns(x, exclude=(key, label_col))   # timestamps etc. are not features
    x = x.select(key, label_col, *features)
    x = C.dedup_rows(x, features, key=key, label_col=label_col, count_col=None)
    x = SP.stratified_split(x, label_col, key, test_fraction, seed)
    if checkpoint:
        x = spread(x.checkpoint(eager=True))   # cut the lineage: later stages re-read this table
    stats = FE.scaler_fit(x.where(F.col("split") == "train"), features)
    return Prepared(x.select(key, label_col, "split", *features), features,
                    FE.scaler_params(stats), fitted)


def preprocess_cicids(df: DataFrame, raw_label: str = "Label", **kw) -> Prepared:
    """Raw CICIDS-style table: trim names, normalise the label, then ``preprocess``."""
    from netwarden.sources.files import strip_column_names
    return preprocess(C.normalize_labels(strip_column_names(df), raw_label), **kw)


__all__ = ["Prepared", "preprocess", "preprocess_cicids", "numeric_columns"]
