"""The flow side of an alert join is reduced by the alert keys before it is exchanged."""
from pyspark.sql import functions as F

from netwarden.operators.alerts import generate_alerts
from netwarden.operators.join import reduce_by_keys


def test_rows_with_a_key_stay_and_others_go(spark):
    rows = spark.range(100_000).select((F.col("id") * 7919 - 5).alias("row_id"), F.col("id").alias("v"), F.lit("x").alias("_b"))
    rows = rows.unionByName(rows.limit(3)).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) row_id, -1L v, 'x' _b"))
    keys = rows.where("v % 100 = 0").select("row_id").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) row_id"))
    got = reduce_by_keys(rows, keys)
    assert got.columns == rows.columns
    found = [r.v for r in got.collect()]
    want = [r.v for r in rows.where("v % 100 = 0").collect()]
    assert sorted(v for v in found if v % 100 == 0) == sorted(want)
    assert len(found) <= len(want) + 5              # a hash of 2^27 values seldom meets one of 1,000 keys
    assert reduce_by_keys(rows, keys.where("false")).count() == 0
    assert reduce_by_keys(rows.where("false"), keys).count() == 0


def test_alerts_exchange_reduced_flows_only(spark):
    det = spark.range(20_000).selectExpr("id AS row_id", "CAST(id % 500 = 0 AS INT) AS final_prediction", "0.95D AS rf_probability")
    flows = spark.range(1, 20_000).selectExpr("id AS row_id", "6 AS protocol_type", "'neptune' AS attack_type")
    alerts = generate_alerts(det, flows)
    plain = generate_alerts(det.join(flows, "row_id", "left"))
    assert sorted(map(str, alerts.collect())) == sorted(map(str, plain.collect())) and alerts.count() == 40
    # the filter lies below the outer join, on the flow side
    tree = alerts._jdf.queryExecution().optimizedPlan().toString()
    assert tree.index("Join LeftOuter") < tree.index("Join Inner") < tree.index("bitmap_construct_agg")
