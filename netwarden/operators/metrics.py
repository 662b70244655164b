"""Exact evaluation metrics as aggregate plans.

Counts come from one pass of ``count_if`` (partial aggregation map-side);
ratios use ``try_divide`` because ANSI mode raises on a zero denominator.
ROC and AUC group by score first (ties collapse, so a score shared by a
third of all rows is one row) and then use a distributed prefix sum.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.operators.ordered import ordered_running
from netwarden.schema import CLASS_NAMES, METRICS_SCHEMA
from netwarden.sources.local import local_table


def _ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    t, p = F.col(y_true), F.col(y_pred)
    return df.agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"), F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"), F.count_if((t == 1) & (p == 1)).alias("tp"))


def confusion_matrix(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """2x2 counts as rows (actual, predicted, n); zero cells kept."""
    c = confusion_counts(df, y_true, y_pred)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                               F.col(n).alias("n"))
                      for a, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(F.inline(cells))


def metrics_from_counts(c: DataFrame, model_name: str, auc: Column | None = None) -> DataFrame:
    """Metric record from a one-row (tn, fp, fn, tp) table; 6 dp like the reference."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    auc_col = F.round(auc, 6) if auc is not None else F.lit(None).cast("double")
    return c.select(
        F.lit(model_name).alias("model_name"),
        F.round(_ratio(tp + tn, n), 6).alias("accuracy"),
        F.round(_ratio(tp, tp + fp), 6).alias("precision"),
        F.round(_ratio(tp, tp + fn), 6).alias("recall"),
        F.round(_ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1_score"),
        auc_col.alias("roc_auc"),
        n.cast("long").alias("n_test_samples"),
        (tp + fp).cast("long").alias("n_attacks_detected"),
        (tp + fn).cast("long").alias("n_attacks_actual"),
        fp.cast("long").alias("false_positives"),
        fn.cast("long").alias("false_negatives"),
    )


def binary_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                   model_name: str = "Model") -> DataFrame:
    return metrics_from_counts(confusion_counts(df, y_true, y_pred), model_name)


def classification_report(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                          digits: int = 4) -> DataFrame:
    """Per class precision / recall / F1 / support, accuracy, macro and weighted rows."""
    return report_from_counts(confusion_counts(df, y_true, y_pred), digits)


def report_from_counts(c: DataFrame, digits: int = 4) -> DataFrame:
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f0, f1 = _ratio(2 * tn, 2 * tn + fn + fp), _ratio(2 * tp, 2 * tp + fp + fn)
    s0, s1 = tn + fp, tp + fn
    acc = _ratio(tp + tn, n)

    def w(a, b):
        return _ratio(a * s0 + b * s1, n)

    def row(name, p, r, f, s):
        rnd = (lambda x: F.round(x, digits) if x is not None else F.lit(None).cast("double"))
        return F.struct(F.lit(name).alias("class_label"), rnd(p).alias("precision"),
                        rnd(r).alias("recall"), rnd(f).alias("f1_score"),
                        s.cast("long").alias("support"))

    rows = F.array(
        row(CLASS_NAMES[0], p0, r0, f0, s0), row(CLASS_NAMES[1], p1, r1, f1, s1),
        row("accuracy", None, None, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", w(p0, p1), w(r0, r1), w(f0, f1), n))
    return c.select(F.inline(rows))


def _score_groups(df: DataFrame, y_true: str, score: str) -> DataFrame:
    """One row per distinct score with its positive / negative counts."""
    pos = F.sum(F.col(y_true).cast("long"))
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.col(score).alias("threshold"))
            .agg(pos.alias("pos"), (F.count(F.lit(1)) - pos).alias("neg")))


def roc_points(df: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """Cumulative TP/FP per distinct score, descending (the threshold sweep)."""
    g = _score_groups(df, y_true, score)
    return ordered_running(g, [F.col("threshold").desc()], ["pos", "neg"], rn_col="point")


def roc_curve(df: DataFrame, y_true: str = "y_true", score: str = "score", digits: int | None = 6) -> DataFrame:
    """FPR / TPR per distinct score, descending, with the (0, 0) start point; exact
    rates where ``digits`` is None."""
    pts = roc_points(df, y_true, score).select(
        "point", "threshold", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))
    # Two scalars (positives, negatives) travel to the driver as literals.
    tot = df.where(F.col(score).isNotNull()).agg(
        F.sum(F.col(y_true).cast("long")).alias("P"),
        (F.count(F.lit(1)) - F.sum(F.col(y_true).cast("long"))).alias("N")).first()
    n_pos, n_neg = float(tot["P"] or 0), float(tot["N"] or 0)
    start = local_table(df.sparkSession, [(0, None, 0, 0)],
                        "point long, threshold double, tp long, fp long")
    curve = pts.unionByName(start)
    tpr = F.try_divide(F.col("tp").cast("double"), F.lit(n_pos))
    fpr = F.try_divide(F.col("fp").cast("double"), F.lit(n_neg))
    if digits is not None:
        tpr, fpr = F.round(tpr, digits), F.round(fpr, digits)
    return curve.select("point", "threshold", "tp", "fp", tpr.alias("tpr"), fpr.alias("fpr"))


def roc_auc(df: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve; ties count half; NULL with a single class."""
    pts = roc_points(df, y_true, score)
    above = F.col("cum_pos") - F.col("pos")
    return pts.agg(
        F.try_divide(F.sum(F.col("neg").cast("double") * (above.cast("double") + F.col("pos") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc")
    ).select(F.round("auc", 6).alias("roc_auc"))


def youden_threshold(df: DataFrame, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """Score maximising the exact TPR - FPR; ties go to the higher threshold (the first point)."""
    curve = roc_curve(df, y_true, score, digits=None).where(F.col("threshold").isNotNull())
    j = F.col("tpr") - F.col("fpr")
    best = F.max_by(F.struct("threshold", "tpr", "fpr"), F.struct(j, F.col("threshold")))
    return curve.agg(best.alias("b")).select(
        "b.threshold", F.round("b.tpr", 6).alias("tpr"), F.round("b.fpr", 6).alias("fpr"),
        F.round(F.col("b.tpr") - F.col("b.fpr"), 6).alias("youden_j"))


def evaluate_model(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                   score: str | None = None, model_name: str = "Model") -> DataFrame:
    """Full metric record for one scored table (AUC only when a score is given)."""
    counts = confusion_counts(df, y_true, y_pred)
    if score is None:
        return metrics_from_counts(counts, model_name)
    auc = roc_auc(df, y_true, score).first()["roc_auc"]  # one scalar
    return metrics_from_counts(counts, model_name, F.lit(auc).cast("double"))


def compare_models(metric_rows: list[DataFrame]) -> DataFrame:
    """Stack metric records and unpivot to (model, metric, percent)."""
    out = metric_rows[0]
    for m in metric_rows[1:]:
        out = out.unionByName(m)
    long = out.unpivot(["model_name"], ["accuracy", "precision", "recall", "f1_score"],
                       "metric", "value")
    return long.select("model_name", "metric", F.round(F.col("value") * 100.0, 4).alias("score_pct"))


def empty_metrics(spark) -> DataFrame:
    return spark.createDataFrame([], METRICS_SCHEMA)
