"""Property tests for the forest, the isolation forest and detection."""
import tempfile

import pytest
from pyspark.sql import functions as F

from netwarden.operators import detect as DT
from netwarden.operators import forest as RF
from netwarden.operators import isolation as IF
from netwarden.operators.profile import class_distribution
from netwarden.operators import metrics as M
from netwarden.operators.join import AlignmentError, align_predictions
from netwarden.sources import adapters as AD

from scales import SF_ORACLE

FEATS = ["f00", "f01", "f02", "f03", "f04"]


@pytest.fixture(scope="module")
def em(spark):
    return AD.em(spark, SF_ORACLE).select("row_id", "label", *FEATS).cache()


def test_forest_separable(spark, em):
    # A feature that separates the classes by construction.
    df = em.withColumn("sep", F.col("label") * 10.0 + F.col("f00"))
    model = RF.train_random_forest(df, FEATS + ["sep"], numTrees=20, maxDepth=5)
    s = RF.score_random_forest(model, df, FEATS + ["sep"])
    auc = M.roc_auc(s.select(F.col("label").alias("y_true"), F.col("rf_probability").alias("score")))
    assert auc.first()["roc_auc"] >= 0.99


def test_isolation_contamination_and_outlier(spark, em):
    m = IF.train_isolation_forest(em, FEATS, n_trees=50, contamination=0.2)
    s = IF.score_samples(m, em)
    share = s.agg(F.avg("if_prediction")).first()[0]
    assert abs(share - 0.2) <= 0.01
    assert len(m.nodes) <= 50 * (2 * m.psi - 1)
    far = spark.createDataFrame([(-1, 0, 50.0, 50.0, 50.0, 50.0, 50.0)],
                                "row_id long, label int, " + ", ".join(f"{f} double" for f in FEATS))
    far_score = IF.score_samples(m, far).first()["if_raw_score"]
    assert far_score < s.agg(F.min("if_raw_score")).first()[0] + 1e-9


def test_isolation_is_row_order_independent(spark, em):
    m = IF.train_isolation_forest(em, FEATS, n_trees=20)
    a = {r["row_id"]: r["if_raw_score"] for r in IF.score_samples(m, em).collect()}
    b = {r["row_id"]: r["if_raw_score"] for r in IF.score_samples(m, em.repartition(7)).collect()}
    assert a == b


def test_save_load_equal_scores(spark, em):
    forest = RF.train_random_forest(em, FEATS, numTrees=10, maxDepth=5)
    iso = IF.train_isolation_forest(em, FEATS, n_trees=20)
    models = DT.ThreatModels(FEATS, {f: (0.0, 1.0) for f in FEATS}, forest, iso)
    path = tempfile.mkdtemp(prefix="nw-models-")
    DT.save_models(models, spark, path)
    loaded = DT.load_models(spark, path)
    a = DT.detect(em, models).orderBy("row_id").collect()
    b = DT.detect(em, loaded).orderBy("row_id").collect()
    assert a == b
    with pytest.raises(FileNotFoundError):
        DT.load_models(spark, path + "-missing")


def test_detect_modes_and_missing_features(spark, em):
    forest = RF.train_random_forest(em, FEATS, numTrees=5, maxDepth=4)
    iso = IF.train_isolation_forest(em, FEATS, n_trees=10)
    models = DT.ThreatModels(FEATS, {}, forest, iso)
    rf_only = DT.detect(em.drop("f04"), models, mode="rf").first()
    assert rf_only["if_prediction"] == 0 and rf_only["if_anomaly_score"] == 0.0
    if_only = DT.detect(em, models, mode="if").first()
    assert if_only["rf_prediction"] == 0 and if_only["rf_confidence"] == 0.0
    with pytest.raises(RuntimeError):
        DT.detect(em, DT.ThreatModels(FEATS))


def test_alignment_is_by_key(spark):
    preds = spark.createDataFrame([(1, 1), (5, 1)], "row_id long, y_pred int")
    flows = spark.createDataFrame([(1, "DoS"), (2, "NORMAL")], "row_id long, attack_type string")
    with pytest.raises(AlignmentError, match="without a flow row: 5"):
        align_predictions(preds, flows).collect()
    ok = align_predictions(preds.where("row_id = 1"), flows).collect()
    assert [(r["row_id"], r["attack_type"]) for r in ok] == [(1, "DoS")]
    one = preds.where("row_id = 1")
    for p, f, complete, why in ((one, flows, True, "without a prediction: 2"), (one.union(one), flows, False, "several predictions"),
                                (one, flows.union(flows), False, "several flow rows"),
                                (one.selectExpr("CAST(NULL AS BIGINT) AS row_id", "y_pred"), flows, False, "without a key")):
        with pytest.raises(AlignmentError, match=why):
            align_predictions(p, f, complete=complete).collect()
    assert align_predictions(one, flows.where("row_id = 1"), complete=True).count() == 1


def test_pipeline_alerts_carry_their_own_context(spark):
    from netwarden.plans.catalog import _pipeline_flows
    from netwarden.plans.pipeline import run_pipeline
    from scales import SF_SMALL
    flows = _pipeline_flows(spark, SF_SMALL)
    res = run_pipeline(flows, forest_params=dict(numTrees=10, maxDepth=6),
                       isolation_params=dict(n_trees=20))
    alerts = res.alerts.select("row_id", "raw_attack_type", "timestamp", "source_ip")
    joined = alerts.join(flows.select("row_id", "attack_type", "ts", "src_ip"), "row_id")
    bad = joined.where((F.col("raw_attack_type") != F.col("attack_type"))
                       | (F.col("timestamp") != F.col("ts")) | (F.col("source_ip") != F.col("src_ip")))
    assert alerts.count() > 0 and bad.count() == 0
    n_pos = res.detections.where("final_prediction = 1").count()
    assert alerts.count() == n_pos
    assert res.rf_metrics.first()["n_test_samples"] == res.detections.count()
    assert res.importances.count() == len(res.prepared.feature_names)


def test_class_tables_take_any_number_of_classes(spark):
    df = spark.range(24_000).select((F.col("id") % 12_000).cast("int").alias("label"), F.col("id").alias("row_id"))
    w = RF.class_weights(df)
    assert w.count() == 12_000 and w.where("n != 2 OR weight != 1.0").isEmpty()
    assert RF.balanced_weights(df).where("class_weight = 1.0").count() == 24_000
    dist = class_distribution(df, "label", classes=(0, -1))
    assert dist.count() == 12_001
    assert dist.where("label = -1").first()["n"] == 0 and dist.agg(F.sum("n")).first()[0] == 24_000


def test_isolation_samples_at_every_size(spark):
    from netwarden.operators.isolation import _sample
    for n in (1, 300, 50_000):
        psi = min(256, n)
        got = _sample(spark.range(n).toDF("row_id"), "row_id", 8, psi, n, 42)
        per = got.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("d"))
        assert {(r["tree"], r["n"], r["d"]) for r in per.collect()} == {(t, psi, psi) for t in range(8)}


def test_bundle_with_one_model(spark, em):
    path = tempfile.mkdtemp(prefix="nw-models-")
    DT.save_models(DT.ThreatModels(["f00,raw"], {}, None, IF.IsolationModel(
        ["f00,raw"], IF.train_isolation_forest(em, FEATS[:1], n_trees=2).nodes, 4)), spark, path)
    loaded = DT.load_models(spark, path)
    assert loaded.forest is None and loaded.isolation.features == ["f00,raw"]


def test_prepared_rows_are_spread_over_the_cores(spark):
    from netwarden.plans.preprocess import ROWS_A_TASK, preprocess
    n = 10 * ROWS_A_TASK
    df = spark.range(n, numPartitions=1).selectExpr("id AS row_id", "CAST(id % 3 = 0 AS INT) AS label", "id * 0.5D AS x", "hash(id) AS y")
    data = preprocess(df).data
    assert data.rdd.getNumPartitions() >= min(spark.sparkContext.defaultParallelism, 10)
    assert data.select("row_id", "x", "y").exceptAll(df.select("row_id", "x", F.col("y").cast("double"))).isEmpty()
    assert data.count() == n and data.where("split = 'train'").count() == n - sum(-(-c // 4) for c in (n - -(-n // 3), -(-n // 3)))


def _noisy(spark, n=4000):
    """Six features, two of them telling something of the class, rows over four partitions."""
    df = spark.range(n, numPartitions=4).selectExpr("id AS row_id", *[f"CAST(abs(hash(id, {i})) % 100003 AS DOUBLE) / 1000 AS x{i}" for i in range(6)])
    df = df.withColumn("label", F.expr("CAST(x0 + 0.5 * x1 + (abs(hash(row_id, 9)) % 40) > 110 AS INT)"))
    return df.cache(), [f"x{i}" for i in range(6)]


def test_forest_is_grown_in_a_few_jobs_however_deep(spark):
    # Spark ML ran a job a level, and held the statistics of every open node in every task of it.
    df, names = _noisy(spark)
    df.count()
    sc = spark.sparkContext
    sc.setJobGroup("deep forest", "deep forest")
    try:
        model = RF.forest_model(RF.train_random_forest(df, names, numTrees=6, maxDepth=20))
        RF.feature_importances(df, names, numTrees=6, maxDepth=30)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(t.depth for t in model.trees) > 10
    assert len(sc.statusTracker().getJobIdsForGroup("deep forest")) <= 24


def test_one_tree_is_that_of_spark_ml(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    from netwarden.operators.features import to_feature_vector
    df, names = _noisy(spark)
    params = dict(numTrees=1, maxDepth=6, minInstancesPerNode=2, bootstrap=False, featureSubsetStrategy="all")
    rows = to_feature_vector(RF.balanced_weights(df), names).withColumn("label", F.col("label").cast("double"))
    theirs = RandomForestClassifier(weightCol="class_weight", seed=42, **params).fit(rows)
    ours = RF.train_random_forest(df, names, **params)
    assert [(t.numNodes, t.depth) for t in theirs.trees] == [(t.numNodes, t.depth) for t in ours.trees]
    a = {r[0]: r[1] for r in theirs.transform(rows).select("row_id", vector_to_array("probability")[1]).collect()}
    b = {r[0]: r[1] for r in RF.score_random_forest(ours, df, names).select("row_id", "rf_probability").collect()}
    assert len(a) == 4000 and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    imp = [r["importance"] for r in RF.feature_importances(df, names, **params).collect()]
    unweighted = RandomForestClassifier(seed=42, **params).fit(rows).featureImportances.toArray()
    assert all(abs(x - y) < 1e-9 for x, y in zip(imp, unweighted))


@pytest.mark.parametrize("depth", [2, 20])
def test_forest_is_the_same_when_its_top_is_split_over_all_tasks(spark, monkeypatch, depth):
    df, names = _noisy(spark)

    def made():
        m = RF.train_random_forest(df, names, numTrees=4, maxDepth=depth, balanced=False)
        scores = RF.score_random_forest(m, df, names).orderBy("row_id").select("row_id", "rf_prediction", "rf_probability").collect()
        return sorted((t.numNodes, t.depth) for t in m.trees), scores, RF.feature_importances(df, names, numTrees=4, maxDepth=depth).collect()

    one = made()
    monkeypatch.setattr(RF, "UNIT_BYTES", 300 * 112)     # nodes of more than 300 rows do not go to one task
    two = made()
    assert one[:2] == two[:2]
    assert all(abs(a["importance"] - b["importance"]) < 1e-9 for a, b in zip(one[2], two[2]))


def test_forest_rows_it_cannot_use(spark):
    df, names = _noisy(spark, 50)
    with pytest.raises(ValueError, match="empty table"):
        RF.train_random_forest(df.where("row_id < 0"), names, balanced=False)
    with pytest.raises(ValueError, match="2 training rows"):
        RF.feature_importances(df.withColumn("x3", F.when(F.col("row_id") > 1, F.col("x3"))), names)
    gap = df.withColumn("x3", F.when(F.col("row_id") > 1, F.col("x3")))
    model = RF.train_random_forest(df, names, numTrees=3)
    assert RF.score_random_forest(model, gap, names).where("rf_probability IS NOT NULL").count() == 50   # missing: above every threshold


def test_bundle_of_an_earlier_version_and_one_written_over(spark, em):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    old = Pipeline(stages=[VectorAssembler(inputCols=FEATS, outputCol="features", handleInvalid="keep"),
                           RandomForestClassifier(numTrees=3, predictionCol="_rf_pred", probabilityCol="_rf_prob", rawPredictionCol="_rf_raw")])
    old = old.fit(em.withColumn("label", F.col("label").cast("double")))
    path = tempfile.mkdtemp(prefix="nw-models-")
    DT.save_models(DT.ThreatModels(FEATS, {}, old), spark, path)
    loaded = DT.load_models(spark, path)
    assert DT.detect(em, loaded, mode="rf").columns == DT.detect(em, DT.ThreatModels(FEATS, {}, old), mode="rf").columns
    new = DT.ThreatModels(FEATS, {}, RF.train_random_forest(em, FEATS, numTrees=3))
    DT.save_models(new, spark, path)
    in_use = DT.load_models(spark, path)
    want = DT.detect(em, new, mode="rf").orderBy("row_id").collect()
    DT.save_models(DT.ThreatModels(FEATS, {}, RF.train_random_forest(em, FEATS, numTrees=2, seed=1)), spark, path)
    assert DT.detect(em, in_use, mode="rf").orderBy("row_id").collect() == want
