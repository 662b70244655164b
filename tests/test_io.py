"""Sources and sinks: missing inputs, round trips, header handling."""
import tempfile

from pyspark.sql import functions as F

from netwarden.operators import metrics as M
from netwarden.schema import ALERT_SCHEMA, METRICS_SCHEMA
from netwarden.sources import adapters as AD
from netwarden.sources import files as IO

from scales import SF_SMALL


def test_missing_alert_log_and_metrics_are_empty(spark):
    missing = tempfile.mkdtemp(prefix="nw-io-") + "/nothing-here"
    a = IO.read_alert_log(spark, missing)
    assert a.count() == 0 and a.schema == ALERT_SCHEMA
    m = IO.read_metrics_json(spark, missing)
    assert m.count() == 0 and m.schema == METRICS_SCHEMA


def test_alert_log_round_trip_is_partitioned(spark):
    al = AD.al(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="nw-io-") + "/alerts"
    IO.write_alert_log(al, path)
    back = IO.read_alert_log(spark, path)
    assert back.columns == [f.name for f in ALERT_SCHEMA.fields]
    assert sorted(back.collect()) == sorted(al.collect())
    # date filters prune partitions
    plan = back.where(F.to_date("timestamp") == "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan


def test_metrics_json_round_trip(spark):
    sc = AD.sc(spark, SF_SMALL)
    m = M.evaluate_model(sc, score="score", model_name="rule")
    path = IO.write_metrics_json(m, tempfile.mkdtemp(prefix="nw-io-") + "/m")
    assert IO.read_metrics_json(spark, path).collect() == m.collect()


def test_csv_dir_with_different_headers(spark):
    d = tempfile.mkdtemp(prefix="nw-io-")
    with open(f"{d}/a.csv", "w") as f:
        f.write(" x , Label\n1.0,BENIGN\n")
    with open(f"{d}/b.csv", "w") as f:
        f.write("x,Label,extra\n2.0,DoS,7\n")
    df = IO.read_flows_dir(spark, [f"{d}/a.csv", f"{d}/b.csv"])
    assert set(df.columns) == {"x", "Label", "extra"}
    rows = sorted((r["x"], r["Label"], r["extra"]) for r in df.collect())
    assert rows == [(1.0, "BENIGN", None), (2.0, "DoS", 7)]


def test_time_range_prunes_alert_log_partitions(spark):
    from netwarden.operators.panels import time_range, timeline_hourly
    al = AD.al(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="nw-io-") + "/alerts"
    IO.write_alert_log(al, path)
    log = IO.read_alert_log(spark, path, keep_partition=True)
    sel = time_range(log, "2024-01-03 00:00:00", "2024-01-05 00:00:00")
    plan = sel._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(alert_date" in plan
    want = al.where((F.col("timestamp") >= "2024-01-03") & (F.col("timestamp") < "2024-01-05"))
    assert sorted(r["row_id"] for r in sel.collect()) == sorted(r["row_id"] for r in want.collect())
    assert timeline_hourly(sel).count() > 0


def test_folder_with_headers_of_every_kind(spark, tmp_path):
    from netwarden.sources.files import header_catalogue, read_flows_csv, read_flows_dir
    (tmp_path / "a.csv").write_text("row_id, Label,value\n1,x,0.5\n2,,Inf\n")
    (tmp_path / "b.csv").write_text("value,row_id, Label\r\n1.5,3,y\r\n")
    (tmp_path / "c.csv").write_text('\ufeffrow_id,"no, te",value\n4,"a, b",\n')
    (tmp_path / "d.csv").write_text("row_id, Label,value\n5,z,2.5\n")
    (tmp_path / "empty.csv").write_text("")
    heads = header_catalogue(spark, str(tmp_path)).collect()
    assert sorted(len(r.files) for r in heads) == [1, 1, 2]
    got = read_flows_dir(spark, str(tmp_path), schema="row_id long, Label string, value double, `no, te` string")
    assert got.columns == ["row_id", "Label", "value", "no, te"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [
        (1, "x", 0.5, None), (2, None, float("inf"), None), (3, "y", 1.5, None), (4, None, None, "a, b"), (5, "z", 2.5, None)]
    inferred = read_flows_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["row_id"], r["Label"]) for r in inferred.collect()) == [(1, "x"), (2, None), (3, "y")]
    with __import__("pytest").raises(Exception, match="PATH_NOT_FOUND"):
        read_flows_csv(spark, str(tmp_path / "none"))
