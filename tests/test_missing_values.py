"""Rows, labels and values that are missing, and rates closer than a rounding step."""
import math

from pyspark.sql import functions as F

from netwarden.functions import scalar as S
from netwarden.operators import alerts as A
from netwarden.operators import features as FE
from netwarden.operators import metrics as M
from netwarden.operators import profile as PR
from netwarden.operators import split as SP


def test_alert_without_flow_row(spark):
    det = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.8), (3, 0, 0.1)],
                                "row_id long, final_prediction int, rf_probability double")
    flows = spark.createDataFrame([(1, "10.0.0.1")], "row_id long, src_ip string")
    assert A.generate_alerts(det, flows).count() == 2


def test_youden_uses_exact_rates(spark):
    # 2,000,001 positives; the two best thresholds differ by one of them
    rows = spark.range(2_000_001).select(F.lit(1).alias("y_true"), F.when(F.col("id") == 0, 0.8).otherwise(0.9).alias("score"))
    rows = rows.union(spark.range(5).select(F.lit(0).alias("y_true"), F.lit(0.1).alias("score")))
    assert M.youden_threshold(rows).first().threshold == 0.8


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (float("nan"), 1.0), (3.0, 6.0)], "a double, b double")
    assert FE.correlation_matrix(df, ["a", "b"]).first()["corr"] == 1.0
    fit = {r["feature"]: r for r in FE.scaler_fit(df, ["a", "b"]).collect()}
    assert fit["a"]["mean"] == 2.0 and not math.isnan(fit["a"]["std"])
    assert FE.drop_correlated(df, ["a", "b"]).columns == ["a"]
    assert df.select(S.clip_confidence("a")).collect()[2][0] == 0.5
    one = df.withColumn("k", F.lit(1))
    assert PR.filter_class(one, "k", 1, ["a"]).count() == 3


def test_rows_without_label_are_split(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.lit(None).cast("int").alias("label"))
    got = {r["split"]: r["count"] for r in SP.stratified_split(df).groupBy("split").count().collect()}
    assert got == {"test": 250, "train": 750}
