"""End-to-end batch run: prepare -> select -> train -> evaluate -> detect -> alert."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from netwarden.operators import forest as RF
from netwarden.operators import isolation as IF
from netwarden.operators.alerts import generate_alerts, sort_alerts
from netwarden.operators.detect import ThreatModels, detect
from netwarden.operators.metrics import evaluate_model
from netwarden.plans.preprocess import Prepared, preprocess


@dataclass
class PipelineResult:
    prepared: Prepared
    selected: list[str]
    models: ThreatModels
    rf_metrics: DataFrame
    if_metrics: DataFrame
    detections: DataFrame
    alerts: DataFrame
    importances: DataFrame


def run_pipeline(flows: DataFrame, top_n: int = 20, mode: str = "combined",
                 forest_params: dict | None = None, isolation_params: dict | None = None,
                 importance_params: dict | None = None, key: str = "row_id") -> PipelineResult:
    """``flows`` carries ``row_id``, ``label``, optional ``attack_type`` and context columns.

    Context (attack type, protocol, time, addresses) is re-attached to alerts
    by joining on ``row_id`` — never by position.
    """
    prep = preprocess(flows, key=key)
    train = prep.train.cache()
    imp = RF.feature_importances(train, prep.feature_names, **(importance_params or {}))
    selected = RF.ranked_features(imp, top_n)
    forest = RF.train_random_forest(train, selected, **(forest_params or {}))
    iso = IF.train_isolation_forest(train, selected, key=key, **(isolation_params or {}))
    models = ThreatModels(selected, prep.scaler, forest, iso, prep.preparation)

    test = prep.test
    det = detect(test, models, mode=mode, pre_scaled=True, keep=(key, "label"))
    det = det.checkpoint(eager=True)             # scored once, read by metrics and alerts
    rf_m = evaluate_model(det, "label", "rf_prediction", "rf_probability", "Random Forest")
    if_m = evaluate_model(det, "label", "if_prediction", None, "Isolation Forest")
    context = flows.drop("label")
    alerts = sort_alerts(generate_alerts(det.drop("label"), context))
    train.unpersist()
    return PipelineResult(prep, selected, models, rf_m, if_m, det, alerts, imp)
