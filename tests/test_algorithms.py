"""Distributed algorithms against brute force on small inputs."""
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from netwarden.operators import split as SP
from netwarden.operators.ordered import ordered_running
from netwarden.operators.quantiles import exact_percentiles
from netwarden.operators.windows import flow_window_features
from netwarden.sources import adapters as AD

from scales import SF_SMALL


def test_bracketed_quantile_matches_exact(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 1013 / 7.0).alias("x"),
                                     (F.col("id") % 3).cast("int").alias("y"))
    for q in (0.5, 0.2, 0.999):
        got = exact_percentiles(df, ["x", "y"], q)
        want = df.agg(F.percentile("x", q).alias("x"), F.percentile("y", q).alias("y")).first()
        assert math.isclose(got["x"], want["x"], rel_tol=1e-12)
        assert math.isclose(got["y"], want["y"], rel_tol=1e-12)


def test_ordered_running_matches_window(spark):
    df = spark.range(0, 3000).select(F.col("id"), ((F.col("id") * 31) % 97).alias("v"))
    got = ordered_running(df, [F.col("v"), F.col("id")], ["v"]).select("id", "rn", "cum_v")
    w = Window.orderBy("v", "id")
    want = df.select("id", F.row_number().over(w).alias("rn"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_v"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_stratified_split_exact(spark):
    ev = AD.ev(spark, SF_SMALL).select("row_id", "label")
    got = {r["row_id"]: r["split"] for r in SP.stratified_split(ev).collect()}
    h = F.md5(F.concat(F.lit("42:"), F.col("row_id").cast("string")))
    w = Window.partitionBy("label").orderBy(h, "row_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    want = ev.select("row_id", F.when(F.row_number().over(w) <= F.ceil(0.25 * n), "test")
                     .otherwise("train").alias("split"))
    assert got == {r["row_id"]: r["split"] for r in want.collect()}


def test_window_features_match_plain_window(spark):
    e = AD.ev(spark, SF_SMALL).select("row_id", "user_id", "attack_type", "ts",
                                      (F.col("attack_type") == "error").cast("int").alias("is_error"))
    got = flow_window_features(e, "user_id", "attack_type", interval="2h", error_col="is_error")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(t).rangeBetween(-2 * 3600 * 10**6, 0)
    want = e.select("row_id", F.count(F.lit(1)).over(w).alias("count"))
    a = {r["row_id"]: r["count"] for r in got.collect()}
    b = {r["row_id"]: r["count"] for r in want.collect()}
    assert a == b


def test_kde_prebinned_close_to_exact(spark):
    from netwarden.operators.histograms import kde_by_class
    ev = AD.ev(spark, SF_SMALL)
    exact = {(r["label"], r["point"]): r["density"] for r in kde_by_class(ev, "value", "label", 50).collect()}
    approx = {(r["label"], r["point"]): r["density"]
              for r in kde_by_class(ev, "value", "label", 50, prebin=10_000).collect()}
    assert exact.keys() == approx.keys()
    peak = max(exact.values())
    assert max(abs(exact[k] - approx[k]) for k in exact) <= 1e-3 * peak + 1e-6


def test_ranked_window_counts_match_plain_window(spark):
    # A hot key: every row gets host 0, so one key holds all rows.
    e = AD.ev(spark, SF_SMALL).select("row_id", F.lit(0).alias("host"), "attack_type", "ts",
                                      (F.col("attack_type") == "error").cast("int").alias("is_error"))
    got = flow_window_features(e, "host", "attack_type", interval="3h", method="ranked")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("host").orderBy(t).rangeBetween(-3 * 3600 * 10**6, 0)
    want = e.select("row_id", F.count(F.lit(1)).over(w).alias("count"),
                    F.sum("is_error").over(w).alias("errs"))
    a = {r["row_id"]: (r["count"], r["serror_rate"]) for r in got.collect()}
    b = {r["row_id"]: (r["count"], round(r["errs"] / r["count"], 6)) for r in want.collect()}
    assert a == b


def test_hash_split_share_and_determinism(spark):
    ev = AD.ev(spark, "/root/testdata/sf0.01").select("row_id", "label")
    a = SP.hash_split(ev)
    share = a.agg(F.avg((F.col("split") == "test").cast("double"))).first()[0]
    assert abs(share - 0.25) < 0.02
    b = SP.hash_split(ev.repartition(5))
    assert sorted(a.collect()) == sorted(b.collect())


def test_approximate_median_fill_close_to_exact(spark):
    from netwarden.operators import clean as C
    g = AD.with_gaps(AD.ev(spark, SF_SMALL)).select("row_id", "value_gap")
    exact = C.median_impute(g, exclude=("row_id",))
    approx = C.median_impute(g, exclude=("row_id",), exact=False)
    filled_e = {r[0] for r in exact.join(g.where("value_gap IS NULL").select("row_id"), "row_id")
                .select("value_gap").collect()}
    filled_a = {r[0] for r in approx.join(g.where("value_gap IS NULL").select("row_id"), "row_id")
                .select("value_gap").collect()}
    assert len(filled_e) == 1 and len(filled_a) == 1
    rng = g.agg(F.max("value_gap") - F.min("value_gap")).first()[0]
    assert abs(filled_e.pop() - filled_a.pop()) <= 0.01 * rng


def test_burst_of_one_key_spreads_over_slices(spark, monkeypatch):
    """Half of all rows are one host's within one interval: equal to the plain windows, also with null
    keys and rows without a time, and no (key, slice) holds more than a slice's share."""
    import random
    from netwarden.operators import windows as W
    rnd = random.Random(4)
    base = 1_700_000_000_000_000
    rows = [(i, "hot" if i < 1500 else rnd.choice(["a", "b", None]), rnd.choice(["x", "y", None]),
             base + (rnd.randrange(2_000_000) if i < 1500 else rnd.randrange(60_000_000)), i % 3 == 0, i % 5 == 0)
            for i in range(3000)] + [(3000, "hot", "x", None, True, True), (3001, None, None, None, False, True)]
    df = spark.createDataFrame(rows, "row_id long, host string, service string, us long, e boolean, r boolean").select(
        "row_id", "host", "service", F.timestamp_micros("us").alias("ts"), F.col("e").cast("int").alias("is_error"),
        F.col("r").cast("int").alias("rej"))
    sizes = []
    plain = W._sliced_sums
    monkeypatch.setattr(W, "_sliced_sums", lambda c, keys, *a: (
        sizes.append(c.groupBy(*keys, "_slice").count().agg(F.max("count")).first()[0]), plain(c, keys, *a))[1])
    got = flow_window_features(df, "host", "service", interval="2s", reject_col="rej")
    assert sizes[0] < 60                                     # of 1500 in one interval
    t = F.unix_micros("ts")
    h, s, hs = (Window.partitionBy(*k).orderBy(t).rangeBetween(-2_000_000, 0)
                for k in (["host"], ["service"], ["host", "service"]))
    n = F.count(F.lit(1))
    want = df.where("ts IS NOT NULL").select(
        "row_id", n.over(h), n.over(s), F.round(F.sum("is_error").over(h) / n.over(h), 6),
        F.round(F.sum("rej").over(s) / n.over(s), 6), F.round(n.over(hs) / n.over(h), 6))
    cols = ["row_id", "count", "srv_count", "serror_rate", "srv_rerror_rate", "same_srv_rate"]
    rows = {r["row_id"]: tuple(r) for r in got.select(*cols).collect()}
    assert len(rows) == 3002 and rows[3000][1] is None and rows[3001][2] is None
    assert {k: v for k, v in rows.items() if k < 3000} == {r["row_id"]: tuple(r) for r in want.collect()}
