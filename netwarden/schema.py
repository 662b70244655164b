"""Schemas, fixed value tables and severity policies."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Flow table (28 features + attack_type + label)
# ---------------------------------------------------------------------------
_D, _I = T.DoubleType(), T.IntegerType()
FLOW_FEATURES: list[tuple[str, T.DataType]] = [
    ("duration", _D), ("protocol_type", _I), ("src_bytes", _D), ("dst_bytes", _D),
    ("land", _I), ("wrong_fragment", _I), ("urgent", _I), ("hot", _I),
    ("num_failed_logins", _I), ("logged_in", _I), ("num_compromised", _I),
    ("root_shell", _I), ("su_attempted", _I), ("num_root", _I),
    ("num_file_creations", _I), ("num_shells", _I), ("num_access_files", _I),
    ("num_outbound_cmds", _I), ("is_host_login", _I), ("is_guest_login", _I),
    ("count", _I), ("srv_count", _I), ("serror_rate", _D), ("srv_serror_rate", _D),
    ("rerror_rate", _D), ("srv_rerror_rate", _D), ("same_srv_rate", _D),
    ("diff_srv_rate", _D),
]
FEATURE_NAMES = [n for n, _ in FLOW_FEATURES]
FLOW_SCHEMA = T.StructType(
    [T.StructField(n, t, True) for n, t in FLOW_FEATURES]
    + [T.StructField("attack_type", T.StringType(), True), T.StructField("label", _I, True)]
)

DETECTION_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("rf_prediction", _I, True),
    T.StructField("rf_confidence", _D, True),
    T.StructField("if_anomaly_score", _D, True),
    T.StructField("if_prediction", _I, True),
    T.StructField("final_prediction", _I, True),
    T.StructField("threat_label", T.StringType(), True),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), True),
    T.StructField("alert_id", T.StringType(), True),
    T.StructField("timestamp", T.TimestampNTZType(), True),
    T.StructField("source_ip", T.StringType(), True),
    T.StructField("destination_ip", T.StringType(), True),
    T.StructField("port", _I, True),
    T.StructField("protocol", T.StringType(), True),
    T.StructField("threat_type", T.StringType(), True),
    T.StructField("raw_attack_type", T.StringType(), True),
    T.StructField("confidence_score", _D, True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("action_required", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("analyst_notes", T.StringType(), True),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType(), True),
    T.StructField("accuracy", _D, True),
    T.StructField("precision", _D, True),
    T.StructField("recall", _D, True),
    T.StructField("f1_score", _D, True),
    T.StructField("roc_auc", _D, True),
    T.StructField("n_test_samples", T.LongType(), True),
    T.StructField("n_attacks_detected", T.LongType(), True),
    T.StructField("n_attacks_actual", T.LongType(), True),
    T.StructField("false_positives", T.LongType(), True),
    T.StructField("false_negatives", T.LongType(), True),
])

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's output text.
# ---------------------------------------------------------------------------
# Attack code -> display name.
THREAT_NAMES = {
    "DoS": "Denial of Service",
    "PortScan": "Port Scan / Reconnaissance",
    "BruteForce": "Brute Force / Credential Attack",
    "DataExfil": "Data Exfiltration",
    "Botnet": "Botnet / C&C Communication",
    "Unknown": "Unknown Threat / Zero-Day",
}
# Protocol code -> name; anything else is reported as TCP.
PROTOCOL_NAMES = {0: "TCP", 1: "UDP", 2: "ICMP"}
DEFAULT_PROTOCOL = "TCP"
# Severity -> recommended action.
SEVERITY_ACTIONS = {
    "CRITICAL": "Block source IP immediately. Escalate to Tier-2 SOC.",
    "HIGH": "Isolate affected host. Capture network packets for forensics.",
    "MEDIUM": "Monitor closely. Apply rate limiting. Alert network team.",
    "LOW": "Log for review. No immediate action required.",
}
# Severity order used for sorting and charts.
SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
THREAT_LABELS = {0: "NORMAL", 1: "⚠ THREAT DETECTED"}
ALERT_STATUS_OPEN = "OPEN"
BENIGN_LABEL = "BENIGN"
CLASS_NAMES = {0: "NORMAL (0)", 1: "ATTACK (1)"}


@dataclass(frozen=True)
class SeverityPolicy:
    """Lower bounds (inclusive) of the confidence for CRITICAL, HIGH, MEDIUM."""
    name: str
    critical: float
    high: float
    medium: float


# Cut-offs applied by the reference code (default) and the documented bands.
CODE_POLICY = SeverityPolicy("code", 0.98, 0.92, 0.80)
DOCUMENTED_POLICY = SeverityPolicy("documented", 0.95, 0.85, 0.70)
POLICIES = {p.name: p for p in (CODE_POLICY, DOCUMENTED_POLICY)}

# Default hyper-parameters of the two detectors.
# Settings of Spark ML's trainer, which the own trainer accepts and does not need.
_ENGINE = dict(cacheNodeIds=True, maxMemoryInMB=1024, checkpointInterval=10)
FOREST_DEFAULTS = dict(numTrees=100, maxDepth=20, minInstancesPerNode=2, seed=42,
                       featureSubsetStrategy="sqrt", **_ENGINE)
IMPORTANCE_FOREST_DEFAULTS = dict(numTrees=50, maxDepth=30, seed=42,
                                  featureSubsetStrategy="sqrt", **_ENGINE)
ISOLATION_DEFAULTS = dict(n_trees=100, max_samples=256, contamination=0.20, seed=42)
SPLIT_SEED = 42
TEST_FRACTION = 0.25
