"""Detections -> severity-ranked alert table, and the alert-table queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.functions.scalar import (
    severity_rank, sql_alert_id, sql_classify_severity, sql_clip_confidence, sql_protocol_name,
    sql_recommend_action, sql_str, sql_threat_type_name,
)
from netwarden.operators.join import reduce_by_keys
from netwarden.schema import ALERT_SCHEMA, ALERT_STATUS_OPEN

ALERT_COLUMNS = [f.name for f in ALERT_SCHEMA.fields]


def filter_threats(df: DataFrame, pred_col: str = "final_prediction") -> DataFrame:
    return df.where(F.col(pred_col) == 1)


def filter_severity(alerts: DataFrame, severities=("CRITICAL", "HIGH")) -> DataFrame:
    return alerts.where(F.col("severity").isin(list(severities)))


def _opt(df: DataFrame, name: str, dtype: str):
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def alert_projection(df: DataFrame, prob_col: str | None = "probability",
                     attack_col: str = "attack_type", protocol_col: str = "protocol_type",
                     ts_col: str = "ts", src_col: str = "src_ip", dst_col: str = "dst_ip",
                     port_col: str = "port", policy=None) -> DataFrame:
    """One projection replaces the reference's per-row alert loop.

    ``df`` holds the positive rows with their row key and context columns.
    Absent context columns become NULL (nothing is invented); an absent
    probability counts as 0.5, i.e. LOW.  Built as SQL text: one JVM call per
    output column.
    """
    cols = set(df.columns)

    def opt(name, dtype):
        return f"CAST(`{name}` AS {dtype})" if name in cols else f"CAST(NULL AS {dtype})"

    p = f"`{prob_col}`" if prob_col and prob_col in cols else "CAST(NULL AS DOUBLE)"
    raw = (f"coalesce(CAST(`{attack_col}` AS STRING), 'Unknown')" if attack_col in cols
           else "'Unknown'")
    proto = f"`{protocol_col}`" if protocol_col in cols else "NULL"
    staged = df.selectExpr(
        "CAST(row_id AS BIGINT) AS row_id", f"{opt(ts_col, 'TIMESTAMP_NTZ')} AS `timestamp`",
        f"{opt(src_col, 'STRING')} AS source_ip", f"{opt(dst_col, 'STRING')} AS destination_ip",
        f"{opt(port_col, 'INT')} AS port", f"{sql_protocol_name(proto)} AS protocol",
        f"{raw} AS raw_attack_type", f"{sql_clip_confidence(p)} AS _conf")
    return staged.selectExpr(
        "row_id", f"{sql_alert_id('row_id')} AS alert_id", "`timestamp`", "source_ip",
        "destination_ip", "port", "protocol", f"{sql_threat_type_name('raw_attack_type')} AS threat_type",
        "raw_attack_type", "round(_conf * 100.0D, 2) AS confidence_score",
        f"{sql_classify_severity('_conf', policy)} AS severity",
        f"{sql_recommend_action(sql_classify_severity('_conf', policy))} AS action_required",
        f"{sql_str(ALERT_STATUS_OPEN)} AS status", "'' AS analyst_notes")


def alerts_from_scored(scored: DataFrame, policy=None) -> DataFrame:
    """Adapter path: scored events -> alerts (user_id plays the source host)."""
    pos = filter_threats(scored, "y_pred").withColumn("src_ip", F.col("user_id").cast("string"))
    return alert_projection(pos, prob_col="score", policy=policy)


def generate_alerts(detections: DataFrame, flows: DataFrame | None = None,
                    prob_col: str = "rf_probability", policy=None) -> DataFrame:
    """Detections (+ optional flow context joined on ``row_id``) -> alerts.

    Alignment is by key, never by position.  When the flow context lives in a
    separate table it is reduced by the keys of the positives (a bitmap filter of
    fixed size) before the exchange, so that only flows with an alert are shuffled.
    A positive without a flow row keeps its alert, with an empty context.
    """
    pos = filter_threats(detections, "final_prediction")
    if flows is not None:
        ctx = [c for c in flows.columns if c not in pos.columns or c == "row_id"]
        pos = pos.join(reduce_by_keys(flows.select(*ctx), pos.select("row_id")), "row_id", "left")
    return alert_projection(pos, prob_col=prob_col, policy=policy)


def sort_alerts(alerts: DataFrame) -> DataFrame:
    """Severity rank, then time, then key (a total order: deterministic)."""
    return alerts.orderBy(severity_rank("severity"), F.col("timestamp").asc_nulls_last(),
                          F.col("row_id"))


def latest_alerts(alerts: DataFrame, n: int = 100, by: str = "stored") -> DataFrame:
    """First ``n`` of the stored order (reference behaviour) or the newest ``n``."""
    if by == "recent":
        ordered = alerts.orderBy(F.col("timestamp").desc_nulls_last(), F.col("row_id").desc())
    else:
        ordered = sort_alerts(alerts)
    return ordered.limit(n)


def top_critical(alerts: DataFrame, n: int = 10) -> DataFrame:
    return sort_alerts(filter_severity(alerts, ("CRITICAL", "HIGH"))).limit(n)


def fill_blank(alerts: DataFrame) -> DataFrame:
    """Missing -> '' for the alert feed: every column rendered as text."""
    return alerts.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                           for c in alerts.columns])


def empty_alerts(spark) -> DataFrame:
    return spark.createDataFrame([], ALERT_SCHEMA)
