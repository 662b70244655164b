"""A multi-batch stream equals the batch answer, and a restart resumes."""
import tempfile

from pyspark.sql import functions as F

from netwarden.operators import alerts as A
from netwarden.operators import panels as P
from netwarden.sources import adapters as AD
from netwarden.streaming import streams as ST

from scales import SF_SMALL


def _files(spark):
    src = tempfile.mkdtemp(prefix="nw-src-")
    ev = AD.read_table(spark, SF_SMALL, "events")
    ev.repartitionByRange(4, "ts").write.mode("overwrite").parquet(src)
    return src, ev.schema


def _alerts(stream):
    return A.alerts_from_scored(AD.score_events(AD.events_as_flows(stream)))


def test_recent_and_kpis_multi_batch(spark):
    src, schema = _files(spark)
    root = tempfile.mkdtemp(prefix="nw-st-")
    s = ST.flow_stream(spark, src, schema, max_files_per_trigger=1)
    ST.run_to_end(ST.stream_recent(_alerts(s), f"{root}/recent", f"{root}/ck1", n=12))
    got = ST.latest_recent(spark, f"{root}/recent", _alerts(s).schema)
    batch = A.latest_alerts(AD.al(spark, SF_SMALL), 12, by="recent")
    assert sorted(r["row_id"] for r in got.collect()) == sorted(r["row_id"] for r in batch.collect())

    s2 = ST.flow_stream(spark, src, schema, max_files_per_trigger=1)
    ST.run_to_end(ST.stream_kpis(_alerts(s2), f"{root}/kpis", f"{root}/ck2"))
    got_k = {r["severity"]: r["n_alerts"]
             for r in ST.current(spark, f"{root}/kpis", "severity string, n_alerts bigint").collect()}
    for table in ("recent", "kpis"):                          # kept versions are bounded, one pointer
        names = __import__("os").listdir(f"{root}/{table}")
        assert sum(x.startswith("v=") for x in names) <= 3 and "current.txt" in names
    want_k = {r["severity"]: r["n_alerts"]
              for r in P.severity_distribution(AD.al(spark, SF_SMALL), fill_zero=False).collect()}
    assert got_k == want_k


def test_detect_stream_restart(spark):
    src, schema = _files(spark)
    root = tempfile.mkdtemp(prefix="nw-st-")
    out, ck = f"{root}/out", f"{root}/ck"
    for _ in range(2):   # second run finds nothing new: no duplicates
        s = ST.flow_stream(spark, src, schema, max_files_per_trigger=2)
        ST.run_to_end(ST.stream_detect(s, _alerts, out, ck))
    got = spark.read.parquet(out)
    assert got.count() == AD.al(spark, SF_SMALL).count()
    assert got.select(F.countDistinct("row_id")).first()[0] == got.count()


def test_model_detection_on_a_stream_equals_batch(spark):
    from netwarden.operators import detect as DT
    from netwarden.operators import forest as RF
    from netwarden.operators import isolation as IF
    feats = ["f00", "f01", "f02", "f03"]
    em = AD.em(spark, SF_SMALL).select("row_id", "label", *feats)
    models = DT.ThreatModels(feats, {}, RF.train_random_forest(em, feats, numTrees=5, maxDepth=4),
                             IF.train_isolation_forest(em, feats, n_trees=10))
    src = tempfile.mkdtemp(prefix="nw-src-")
    em.repartition(3).write.mode("overwrite").parquet(src)
    root = tempfile.mkdtemp(prefix="nw-st-")
    s = ST.flow_stream(spark, src, em.schema, max_files_per_trigger=1)
    ST.run_to_end(ST.stream_detect(s, lambda f: DT.detect(f, models), f"{root}/out", f"{root}/ck"))
    got = sorted(spark.read.parquet(f"{root}/out").collect())
    want = sorted(DT.detect(em, models).collect())
    assert got == want


def test_trailing_sums_of_a_stream_equal_the_batch(spark):
    """Several batches, hosts that come back after their state was dropped, and null keys; closing twice adds nothing."""
    from pyspark.sql import Window
    src = tempfile.mkdtemp(prefix="nw-src-")
    ev = AD.ev(spark, SF_SMALL).select("row_id", F.when(F.col("user_id") % 7 != 0, F.col("user_id") % 5).alias("host"), "ts",
                                       F.col("label").alias("e"))
    for k in range(4):                      # files arrive in the order of their rows, give or take the watermark
        ev.where(F.col("row_id").between(250 * k, 250 * k + 249)).coalesce(1).write.mode("append").parquet(src)
    root = tempfile.mkdtemp(prefix="nw-st-")
    for _ in range(2):
        ST.run_finished(spark, lambda: ST.stream_trailing_sums(
            ST.flow_stream(spark, src, ev.schema, max_files_per_trigger=1), ["host"], f"{root}/out", f"{root}/ck",
            interval="6h", sums={"errors": "e"}, watermark="30 minutes"), f"{root}/ck")
    w = Window.partitionBy("host").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-6 * 3600 * 10**6, 0)
    want = ev.select("row_id", F.count(F.lit(1)).over(w), F.sum("e").over(w))
    assert sorted(map(tuple, spark.read.parquet(f"{root}/out").collect())) == sorted(map(tuple, want.collect()))
