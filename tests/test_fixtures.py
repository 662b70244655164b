"""Hand-written fixtures: severity boundaries, rule score, raw CICIDS CSV."""
import tempfile

from pyspark.sql import functions as F

from netwarden.functions import rules as R
from netwarden.functions import scalar as S
from netwarden.operators import clean as C
from netwarden.sources.files import read_flows_csv


def test_severity_boundaries(spark):
    rows = [(0.98, "CRITICAL"), (0.9799, "HIGH"), (0.92, "HIGH"), (0.9199, "MEDIUM"),
            (0.80, "MEDIUM"), (0.7999, "LOW"), (0.10, "LOW"), (None, "LOW")]
    df = spark.createDataFrame(rows, "p double, expected string")
    out = df.select("expected", S.classify_severity(S.clip_confidence("p")).alias("got"),
                    S.clip_confidence("p").alias("conf")).collect()
    for r in out:
        assert r["got"] == r["expected"]
    assert [r["conf"] for r in out][-2:] == [0.5, 0.5]


def test_documented_policy(spark):
    df = spark.createDataFrame([(0.95,), (0.9499,), (0.85,), (0.70,), (0.6999,)], "p double")
    got = [r[0] for r in df.select(S.classify_severity("p", "documented")).collect()]
    assert got == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]


def test_rule_score_fixture(spark):
    rows = [(0.05, 0.10, 5, 0.90, 0, 0.0, 0, "NORMAL", "Benign Connection"),
            (0.90, 0.10, 300, 0.20, 0, 0.0, 75, "THREAT", "DoS / DDoS Attack"),
            (0.10, 0.80, 10, 0.10, 3, 0.0, 70, "THREAT", "Brute Force / Credential Attack"),
            (0.10, 0.80, 10, 0.10, 0, 0.6, 65, "SUSPICIOUS", "Anomalous Traffic Pattern"),
            (0.50, 0.60, 200, 0.30, 2, 0.5, 0, "NORMAL", "Benign Connection"),
            (0.90, 0.90, 500, 0.10, 5, 0.9, 100, "THREAT", "DoS / DDoS Attack")]
    schema = ("serror_rate double, diff_srv_rate double, count int, same_srv_rate double, "
              "num_failed_logins int, rerror_rate double, score int, verdict string, kind string")
    df = spark.createDataFrame(rows, schema).withColumn("got", R.rule_threat_score())
    out = df.select("score", "got", "verdict", R.rule_verdict("got").alias("v"), "kind",
                    R.rule_threat_type("got").alias("k")).collect()
    for r in out:
        assert (r["got"], r["v"], r["k"]) == (r["score"], r["verdict"], r["kind"])


def test_threat_and_protocol_names(spark):
    df = spark.createDataFrame([("DoS", 0.0), ("Weird", 1.7), (None, 2.0), ("Unknown", 7.0), ("Botnet", None)],
                               "raw string, proto double")
    out = df.select(S.threat_type_name("raw").alias("t"), S.protocol_name("proto").alias("p")).collect()
    assert [r["t"] for r in out] == ["Denial of Service", "Weird", "Unknown Threat / Zero-Day",
                                     "Unknown Threat / Zero-Day", "Botnet / C&C Communication"]
    assert [r["p"] for r in out] == ["TCP", "UDP", "ICMP", "TCP", "TCP"]


CSV = """ Flow Bytes/s, Label
Infinity,BENIGN
NaN,DoS Hulk
,PortScan
-Infinity,DoS Hulk
1.5,BENIGN
2.5,
"""


def test_cicids_csv_chain(spark):
    d = tempfile.mkdtemp(prefix="nw-csv-")
    with open(f"{d}/flows.csv", "w") as f:
        f.write(CSV)
    df = read_flows_csv(spark, f"{d}/flows.csv")
    assert df.columns == ["Flow Bytes/s", "Label"]
    df = df.withColumn("_pos", F.monotonically_increasing_id())
    assert C.inf_count(df).first()["n_infinite"] == 2
    cleaned = C.inf_to_null(df)
    assert cleaned.where(F.col("Flow Bytes/s").isNull()).count() == 4
    filled = C.median_impute(cleaned, ["Flow Bytes/s"])
    assert sorted({r[0] for r in filled.select("Flow Bytes/s").collect()}) == [1.5, 2.0, 2.5]
    labels = [r["label"] for r in C.normalize_labels(filled).orderBy("_pos").collect()]
    assert labels == [0, 1, 1, 1, 0, 1]


def test_require_columns(spark):
    import pytest
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(ValueError):
        C.require_columns(df, "label")


def test_local_table_round_trip(spark):
    import datetime as dt
    from netwarden.sources.local import local_table
    rows = [("it's", 1, 2.5, None, dt.datetime(2024, 1, 2, 3, 4, 5, 6)),
            (None, None, float("inf"), True, None)]
    df = local_table(spark, rows, "s string, i int, d double, b boolean, t timestamp_ntz")
    assert [tuple(r) for r in df.collect()] == rows
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "int", "double", "boolean",
                                                                     "timestamp_ntz"]


def test_constant_column_correlation_and_scaler(spark):
    from netwarden.operators import features as FE
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, 1.0), (3.0, 5.0, 3.0), (4.0, 5.0, 2.0)],
                               "a double, c double, g double")
    corr = {(r["feature_a"], r["feature_b"]): r["corr"]
            for r in FE.correlation_matrix(df, ["a", "c", "g"]).collect()}
    assert corr[("a", "c")] is None                      # constant column: undefined, no error
    assert corr[("a", "g")] == 0.5                       # pairwise-complete rows (2,1) (3,3) (4,2)
    params = FE.scaler_params(FE.scaler_fit(df, ["a", "c"]))
    assert params["c"] == (5.0, 1.0)                     # zero std -> divisor 1
    scaled = FE.scale_features(df, params).select("c").distinct().collect()
    assert [r["c"] for r in scaled] == [0.0]


def test_empty_inputs(spark):
    from netwarden.operators import alerts as A
    from netwarden.operators import panels as P
    empty = A.empty_alerts(spark)
    k = P.alert_kpis(empty).first()
    assert (k["total_alerts"], k["critical"], k["unique_src_ips"], k["avg_confidence"],
            k["max_confidence"]) == (0, 0, 0, 0.0, 0.0)
    sev = {r["severity"]: r["n_alerts"] for r in P.severity_distribution(empty).collect()}
    assert sev == {"CRITICAL": 0, "HIGH": 0, "MEDIUM": 0, "LOW": 0}
    det = spark.createDataFrame([(1, 0, None)], "row_id long, final_prediction int, rf_probability double")
    assert A.generate_alerts(det).count() == 0
