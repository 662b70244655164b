"""Recorded isolation-forest counts must reproduce the recorded metrics."""
from pyspark.sql import functions as F

from netwarden.operators import metrics as M


def _golden(spark):
    # TP 2528, FP 0, FN 1222, TN 8750 as 12,500 rows
    ids = spark.range(12500)
    y_true = F.when(F.col("id") < 3750, 1).otherwise(0)
    y_pred = F.when(F.col("id") < 2528, 1).otherwise(0)
    return ids.select(y_true.alias("y_true"), y_pred.alias("y_pred"))


def test_binary_metrics(spark):
    r = M.binary_metrics(_golden(spark), model_name="Isolation Forest").first()
    assert r["accuracy"] == 0.90224
    assert r["precision"] == 1.0
    assert r["recall"] == 0.674133
    assert r["f1_score"] == 0.805352
    assert (r["n_test_samples"], r["n_attacks_detected"], r["n_attacks_actual"]) == (12500, 2528, 3750)
    assert (r["false_positives"], r["false_negatives"]) == (0, 1222)
    assert r["roc_auc"] is None


def test_classification_report(spark):
    rows = {r["class_label"]: r for r in M.classification_report(_golden(spark)).collect()}
    n = rows["NORMAL (0)"]
    assert (n["precision"], n["recall"], n["f1_score"], n["support"]) == (0.8775, 1.0, 0.9347, 8750)
    a = rows["ATTACK (1)"]
    assert (a["precision"], a["recall"], a["f1_score"], a["support"]) == (1.0, 0.6741, 0.8054, 3750)
    m = rows["macro avg"]
    assert (m["precision"], m["recall"], m["f1_score"]) == (0.9387, 0.8371, 0.87)
    w = rows["weighted avg"]
    assert (w["precision"], w["recall"], w["f1_score"]) == (0.9142, 0.9022, 0.8959)
    assert rows["accuracy"]["f1_score"] == 0.9022


def test_confusion_zero_cells(spark):
    cells = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(_golden(spark)).collect()}
    assert cells == {(0, 0): 8750, (0, 1): 0, (1, 0): 1222, (1, 1): 2528}


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    r = M.binary_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1_score"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "y_true int, score double")
    # pairs (pos, neg): (0.9,0.9)=.5 (0.9,0.1)=1 (0.8,0.9)=0 (0.8,0.1)=1 -> 2.5/4
    assert M.roc_auc(df).first()["roc_auc"] == 0.625
    one = spark.createDataFrame([(1, 0.9), (1, 0.2)], "y_true int, score double")
    assert M.roc_auc(one).first()["roc_auc"] is None


def test_youden_prefers_higher_threshold_on_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.4), (0, 0.1)], "y_true int, score double")
    r = M.youden_threshold(df).first()
    # J(0.9)=0.5, J(0.5)=0.0, J(0.4)=0.5 -> tie, the higher threshold wins
    assert r["threshold"] == 0.9 and r["youden_j"] == 0.5
