"""Isolation forest (Liu, Ting & Zhou, ICDM 2008) as Spark jobs.

* Sampling: each tree draws its own ``psi = min(max_samples, n)`` rows without
  replacement, those with its smallest seeded hashes.  A row is copied only to
  the trees whose hash cut it passes (about ``2 psi + 64`` rows per tree,
  whatever n is), so one narrow pass gathers all samples.
* Growing: ``groupBy(tree).applyInPandas`` — one small group (<= psi rows)
  per tree, grown in numpy.
* Scoring: the node table has at most ``trees * (2 psi - 1)`` rows; it is
  shipped with the task closure and every partition is scored vectorised in
  ``mapInPandas`` (Arrow batches), so the full data never leaves its tasks.
* Threshold: ``offset`` = the exact ``contamination`` quantile of the
  training scores (distributed quantile), decision = score - offset.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.operators.quantiles import exact_percentiles
from netwarden.schema import ISOLATION_DEFAULTS
from netwarden.session import checkpoint_dir

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")


def average_path_length(n):
    """c(n): mean unsuccessful-search path length in a BST of n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


@dataclass
class IsolationModel:
    features: list[str]
    nodes: pd.DataFrame          # NODE_SCHEMA columns, bounded by trees * (2 psi - 1)
    psi: int
    offset: float = 0.0
    contamination: float = 0.2

    @property
    def n_trees(self) -> int:
        return int(self.nodes["tree"].nunique())


def _sample(df: DataFrame, key: str, n_trees: int, psi: int, n: int, seed: int) -> DataFrame:
    """The ``psi`` rows of each tree. The cut lets 2 psi + 64 rows of a tree pass on average; that
    fewer than psi do is out of reach of any real table (below 1e-15)."""
    share = min(1.0, (2 * psi + 64) / n)
    cut = min(int(-(2 ** 63) + share * (2 ** 64 - 1)), 2 ** 63 - 1)

    def draw(tree):
        return F.xxhash64(F.lit(seed), tree, F.col(key))

    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: draw(t) <= F.lit(cut))
    drawn = df.withColumn("tree", F.explode(trees)).withColumn("_h", draw(F.col("tree")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_h", key))
    return drawn.withColumn("_r", rank).where(F.col("_r") <= psi).drop("_h", "_r")


def _grower(features: list[str], psi: int, seed: int):
    limit = max(1, math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        X = pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        rows = []
        todo = [(np.arange(len(X)), 0, 0)]
        next_id = 1
        while todo:
            idx, depth, node = todo.pop()
            sub = X[idx]
            lo, hi = np.nanmin(sub, axis=0), np.nanmax(sub, axis=0)
            splittable = np.flatnonzero(hi > lo)
            if depth >= limit or len(idx) <= 1 or splittable.size == 0:
                rows.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
                continue
            f = int(rng.choice(splittable))
            thr = float(rng.uniform(lo[f], hi[f]))
            go_left = sub[:, f] < thr
            left, right = next_id, next_id + 1
            next_id += 2
            rows.append((tree, node, f, thr, left, right, len(idx), depth))
            todo.append((idx[go_left], depth + 1, left))
            todo.append((idx[~go_left], depth + 1, right))
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right",
                                           "size", "depth"])
    return grow


def train_isolation_forest(train: DataFrame, features: list[str], key: str = "row_id",
                           exact_threshold: bool = True, **overrides) -> IsolationModel:
    """Grow the forest on a hash sample; set the offset from training scores
    (exact quantile, or ``percentile_approx`` with ``exact_threshold=False``)."""
    p = {**ISOLATION_DEFAULTS, **overrides}
    n_trees, seed, contamination = p["n_trees"], p["seed"], p["contamination"]
    n = train.count()
    psi = int(min(p["max_samples"], n))
    if psi < 1:
        raise ValueError("cannot train an isolation forest on an empty table")
    x = train.selectExpr(f"`{key}`", *[f"CAST(`{f}` AS DOUBLE) AS `{f}`" for f in features])
    sample = _sample(x, key, n_trees, psi, n, seed)
    nodes = (sample.select("tree", *features).groupBy("tree")
             .applyInPandas(_grower(features, psi, seed), NODE_SCHEMA))
    pdf = nodes.toPandas()                       # <= n_trees * (2 psi - 1) rows
    model = IsolationModel(features, pdf, psi, 0.0, contamination)
    checkpoint_dir(train.sparkSession)          # scored once; the quantile reads the stored scores
    scored = score_samples(model, train.select(*features)).select("if_raw_score").checkpoint(eager=True)
    if exact_threshold:
        model.offset = float(exact_percentiles(scored, ["if_raw_score"], contamination)["if_raw_score"])
    else:
        model.offset = float(scored.agg(F.percentile_approx("if_raw_score", contamination, 10_000)).first()[0])
    return model


def _tree_arrays(nodes: pd.DataFrame):
    out = []
    for _, t in nodes.groupby("tree"):
        t = t.sort_values("node")
        size = int(t["node"].max()) + 1
        feat = np.full(size, -1, dtype=np.int64)
        thr = np.zeros(size)
        left = np.full(size, -1, dtype=np.int64)
        right = np.full(size, -1, dtype=np.int64)
        depth = np.zeros(size)
        n = np.zeros(size)
        ids = t["node"].to_numpy()
        feat[ids], thr[ids] = t["feature"].to_numpy(), t["threshold"].to_numpy()
        left[ids], right[ids] = t["left"].to_numpy(), t["right"].to_numpy()
        depth[ids], n[ids] = t["depth"].to_numpy(), t["size"].to_numpy()
        leaf_len = depth + average_path_length(n)
        out.append((feat, thr, left, right, leaf_len))
    return out


def _scorer(model: IsolationModel, out_cols: list[str]):
    trees = _tree_arrays(model.nodes)
    norm = float(average_path_length([model.psi])[0]) or 1.0
    feats = list(model.features)
    offset = model.offset

    def score(batches):
        for pdf in batches:
            X = pdf[feats].to_numpy(dtype=float)
            m = len(X)
            total = np.zeros(m)
            rows = np.arange(m)
            for feat, thr, left, right, leaf_len in trees:
                node = np.zeros(m, dtype=np.int64)
                while True:
                    f = feat[node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    val = X[rows[inner], f[inner]]
                    go_left = val < thr[node[inner]]
                    node[inner] = np.where(go_left, left[node[inner]], right[node[inner]])
                total += leaf_len[node]
            raw = -np.power(2.0, -(total / len(trees)) / norm)
            pdf = pdf.assign(if_raw_score=raw, if_anomaly_score=np.round(raw - offset, 6))
            pdf["if_prediction"] = (raw - offset < 0).astype("int32")
            yield pdf[out_cols]
    return score


def score_samples(model: IsolationModel, df: DataFrame) -> DataFrame:
    """Adds ``if_raw_score`` (= -s, lower is more anomalous), ``if_anomaly_score``
    (decision = raw - offset, 6 dp) and ``if_prediction`` (decision < 0)."""
    from netwarden.operators.features import cast_double
    x = cast_double(df, model.features)
    cols = x.columns + ["if_raw_score", "if_anomaly_score", "if_prediction"]
    schema = T.StructType(x.schema.fields + [
        T.StructField("if_raw_score", T.DoubleType()), T.StructField("if_anomaly_score", T.DoubleType()),
        T.StructField("if_prediction", T.IntegerType())])
    return x.mapInPandas(_scorer(model, cols), schema)


def save_isolation(model: IsolationModel, spark, path: str) -> str:
    spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = [(list(model.features), model.psi, model.offset, model.contamination)]
    spark.createDataFrame(meta, "features array<string>, psi int, offset double, contamination double") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def load_isolation(spark, path: str) -> IsolationModel:
    m = spark.read.parquet(f"{path}/meta").first()
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    return IsolationModel(list(m["features"]), nodes, m["psi"], m["offset"], m["contamination"])
