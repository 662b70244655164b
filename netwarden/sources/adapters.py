"""Views over the driver's test tables that give them the flow-table shape.

``ev``  events as flows: row key, time, host, class label, numeric features
``sc``  ``ev`` + a score and a thresholded prediction
``al``  alerts built from ``sc`` rows predicted positive
``li``  lineitem's four double measures (no row key)
``em``  embeddings unpacked to 64 feature columns with a binary label

All columns are plain expressions, so Catalyst prunes and pushes filters
straight into the parquet scans.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.session import table_path

SCORE_SCALE = 82.0        # score = least(value / 82, 1)
PRED_CUT = 0.5            # y_pred = score >= 0.5
EMBED_DIM = 64
EMBED_POSITIVE = 3        # em label = (label = 3)
LI_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EV_FEATURES = ["value", "k", "user_id", "hour_of_day", "protocol_type"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def events_as_flows(events: DataFrame) -> DataFrame:
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    return events.selectExpr(
        "event_id AS row_id", "ts", "user_id", "event_type AS attack_type",
        "CAST(event_type = 'error' AS INT) AS label", "value", f"{k} AS k",
        "hour(ts) AS hour_of_day", f"{k} % 4 AS protocol_type")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_flows(read_table(spark, sf_dir, "events"))


def with_gaps(df: DataFrame) -> DataFrame:
    """Deterministic missing values for cleaning tests (test tables hold none)."""
    return df.withColumns({
        "value_gap": F.when(F.col("k") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("value")),
        "k7": F.when(F.col("k") % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("k") % 7),
        "attack_gap": F.when(F.col("k") % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("attack_type")),
    })


def score_events(flows: DataFrame) -> DataFrame:
    return flows.selectExpr(
        "*", f"least(value / {SCORE_SCALE!r}D, 1.0D) AS score", "label AS y_true",
        f"CAST(value / {SCORE_SCALE!r}D >= {PRED_CUT!r}D AS INT) AS y_pred")


def sc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_events(ev(spark, sf_dir))


def al(spark: SparkSession, sf_dir: str, policy=None) -> DataFrame:
    from netwarden.operators.alerts import alerts_from_scored
    return alerts_from_scored(sc(spark, sf_dir), policy=policy)


def li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(*LI_MEASURES)


def em(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    feats = [f"CAST(embedding[{i}] AS DOUBLE) AS f{i:02d}" for i in range(EMBED_DIM)]
    return e.selectExpr("vec_id AS row_id", *feats, f"CAST(label = {EMBED_POSITIVE} AS INT) AS label")


EM_FEATURES = [f"f{i:02d}" for i in range(EMBED_DIM)]
