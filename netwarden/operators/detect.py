"""Detection: score with both models and combine the verdicts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.functions.scalar import threat_label

MODES = ("rf", "if", "combined")


def combine_verdicts(df: DataFrame, mode: str = "combined") -> DataFrame:
    """Fix the unused side to 0 / 0.0 and OR the two verdicts.

    Expects ``rf_prediction, rf_confidence`` (mode rf/combined) and
    ``if_anomaly_score, if_prediction`` (mode if/combined).
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    out = df
    if mode == "if":
        out = out.withColumns({"rf_prediction": F.lit(0), "rf_confidence": F.lit(0.0)})
    if mode == "rf":
        out = out.withColumns({"if_anomaly_score": F.lit(0.0), "if_prediction": F.lit(0)})
    final = ((F.col("rf_prediction") == 1) | (F.col("if_prediction") == 1)).cast("int")
    out = out.withColumn("final_prediction", final)
    return out.withColumn("threat_label", threat_label("final_prediction"))


# ---------------------------------------------------------------------------
# Scoring with trained models
# ---------------------------------------------------------------------------
from dataclasses import dataclass, field  # noqa: E402

from netwarden.operators.clean import Preparation  # noqa: E402


@dataclass
class ThreatModels:
    """Scaler (by feature name), forest pipeline, isolation forest, and the fitted preparation that
    raw flows need first."""
    feature_names: list[str]
    scaler: dict = field(default_factory=dict)
    forest: object = None          # netwarden.operators.forest.ForestModel
    isolation: object = None       # netwarden.operators.isolation.IsolationModel
    preparation: Preparation | None = None

    @property
    def ready(self) -> bool:
        return self.forest is not None or self.isolation is not None


def detect(flows: DataFrame, models: ThreatModels, mode: str = "combined",
           pre_scaled: bool = False, keep=("row_id",)) -> DataFrame:
    """Detection table: ``row_id``, forest and isolation verdicts, final verdict, label.

    Raw flows (not ``pre_scaled``) first go through the models' preparation: infinities and
    gaps to the fitted medians, texts to the fitted codes (unseen: -1). Absent
    features count as 0 (``default_features``); scaling is by name. Both scorers are narrow transformations of the same rows: no join.
    """
    from netwarden.operators.features import default_features, scale_features
    from netwarden.operators.forest import score_random_forest
    from netwarden.operators.isolation import score_samples

    if not models.ready:
        raise RuntimeError("models not set: train or load them first")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    feats = models.feature_names
    x = flows
    if not pre_scaled and models.preparation is not None:
        x = models.preparation.apply(flows.select(*[c for c in flows.columns if c in feats or c in keep]))
    x = default_features(x, feats)
    if not pre_scaled and models.scaler:
        x = scale_features(x, {f: models.scaler[f] for f in feats if f in models.scaler})
    x = x.select(*[k for k in keep if k in x.columns], *feats)
    if mode in ("rf", "combined"):
        x = score_random_forest(models.forest, x, feats)
    else:
        x = x.withColumns({"rf_prediction": F.lit(0), "rf_probability": F.lit(None).cast("double"),
                           "rf_confidence": F.lit(0.0)})
    if mode in ("if", "combined"):
        x = score_samples(models.isolation, x).drop("if_raw_score")
    x = combine_verdicts(x, mode)
    return x.select(*[k for k in keep if k in x.columns], "rf_prediction", "rf_probability",
                    "rf_confidence", "if_anomaly_score", "if_prediction", "final_prediction",
                    "threat_label")


def save_models(models: ThreatModels, spark, path: str) -> str:
    """Trees, scaler, isolation nodes, medians and code dictionaries as parquet, names kept."""
    from netwarden.operators.forest import save_forest
    from netwarden.operators.isolation import save_isolation
    rows = [(f, *models.scaler.get(f, (0.0, 1.0)), i) for i, f in enumerate(models.feature_names)]
    spark.createDataFrame(rows, "feature string, mean double, std double, position int") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    fitted = models.preparation
    parts = [(models.forest is not None, models.isolation is not None, fitted is not None)]
    spark.createDataFrame(parts, "forest boolean, isolation boolean, preparation boolean") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    if models.forest is not None:
        save_forest(models.forest, spark, f"{path}/forest")
    if fitted is not None:
        spark.createDataFrame(list(fitted.medians.items()), "feature string, median double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/medians")
        codes = fitted.codes
        if codes is None:
            codes = spark.createDataFrame([], "column string, value string, code int")
        codes.write.mode("overwrite").parquet(f"{path}/codes")
        spark.createDataFrame([(c,) for c in fitted.text], "feature string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/text")
    if models.isolation is not None:
        save_isolation(models.isolation, spark, f"{path}/isolation")
    return path


def load_models(spark, path: str) -> ThreatModels:
    """Load a saved bundle with the models it was saved with. A folder that holds no bundle
    raises FileNotFoundError; other errors come through as they are."""
    from pyspark.errors import AnalysisException
    from netwarden.operators.forest import load_forest
    from netwarden.operators.isolation import load_isolation
    try:
        parts = spark.read.parquet(f"{path}/parts").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"model files not found under {path}: run training first") from e
    sc = spark.read.parquet(f"{path}/scaler").orderBy("position").collect()
    forest = load_forest(spark, f"{path}/forest") if parts["forest"] else None
    iso = load_isolation(spark, f"{path}/isolation") if parts["isolation"] else None
    fitted = None
    if "preparation" in parts and parts["preparation"]:
        fitted = Preparation({r["feature"]: r["median"] for r in spark.read.parquet(f"{path}/medians").collect()},
                             [r["feature"] for r in spark.read.parquet(f"{path}/text").collect()],
                             spark.read.parquet(f"{path}/codes"))
    return ThreatModels([r["feature"] for r in sc], {r["feature"]: (r["mean"], r["std"]) for r in sc},
                        forest, iso, fitted)
