"""Class-balanced random forest, and feature importances.

The forest is that of Spark ML (32 quantile bins, Poisson bags, drawn features, Gini gain, leaves of one
prediction merged), grown another way: Spark ML keeps a histogram of every open node in every task, which
for deep trees is far more than the rows. Here nodes of more rows than a task should hold are split by
histograms summed over the tasks; the rows of a smaller node, or of the root, go to one task, which grows
the whole subtree. The trees stay in the shared folder and reach the executors as files.
"""
from __future__ import annotations

import math
import os
from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.operators import trees
from netwarden.operators.features import cast_double, to_feature_vector
from netwarden.operators.histograms import attach_small
from netwarden.schema import FOREST_DEFAULTS, IMPORTANCE_FOREST_DEFAULTS
from netwarden.session import checkpoint_dir, scratch_path
from netwarden.sources.local import local_table

#: Bytes that the rows of one node may take in the task that grows it (a row: its bins twice, and about 100).
UNIT_BYTES = 256 << 20
#: Settings of Spark ML's trainer that say nothing about the forest; accepted, not needed.
ENGINE_ONLY = ("cacheNodeIds", "maxMemoryInMB", "checkpointInterval")


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, weight) with weight = n_total / (n_classes * n_class), for any number of classes."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total, k = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.select(label_col, "n", (total / (k * F.col("n"))).alias("weight"))


def balanced_weights(df: DataFrame, label_col: str = "label", weight_col: str = "class_weight") -> DataFrame:
    """Attach the balanced class weight to every row (the class table is broadcast where its
    counted size allows it, else joined by a shuffle)."""
    w = class_weights(df, label_col).select(label_col, F.col("weight").alias(weight_col))
    return attach_small(df, w, label_col, how="left")


@dataclass(frozen=True)
class TreeShape:
    numNodes: int
    depth: int


@dataclass
class ForestModel:
    """Trees as a folder of parquet files, one row per subtree."""
    features: list[str]
    thresholds: list[list[float]]
    classes: int
    path: str
    trees: list[TreeShape] = field(default_factory=list)

    def files(self, spark: SparkSession) -> list[str]:
        """Names under which every executor has the files (handed out by Spark)."""
        paths = sorted(spark.read.parquet(self.path).inputFiles())
        for p in paths:
            spark.sparkContext.addFile(p)
        return [os.path.basename(p) for p in paths]


def _spec(params: dict, n_features: int, n_classes: int, n_rows: int) -> trees.Spec:
    """Parameters by their Spark ML names and defaults."""
    p = {"numTrees": 20, "maxDepth": 5, "maxBins": 32, "minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0,
         "minInfoGain": 0.0, "impurity": "gini", "subsamplingRate": 1.0, "bootstrap": True, "featureSubsetStrategy": "auto",
         "seed": 42}
    if unknown := set(params) - set(p):
        raise ValueError(f"unknown forest parameters: {', '.join(sorted(unknown))}")
    p |= params
    if p["impurity"] not in ("gini", "entropy"):
        raise ValueError("impurity must be gini or entropy")
    if not 0 <= p["maxDepth"] <= 30:
        raise ValueError("maxDepth must be between 0 and 30")
    draw = str(p["featureSubsetStrategy"])
    if draw == "auto":
        draw = "sqrt" if p["numTrees"] > 1 else "all"
    named = {"all": n_features, "sqrt": math.ceil(math.sqrt(n_features)), "onethird": math.ceil(n_features / 3.0),
             "log2": max(1, math.ceil(math.log2(n_features)))}
    n_draw = named.get(draw) or (min(int(draw), n_features) if draw.isdigit() else math.ceil(float(draw) * n_features))
    return trees.Spec(p["numTrees"], n_features, n_classes, max(1, min(p["maxBins"], n_rows)), n_draw, p["maxDepth"],
                      p["minInstancesPerNode"], p["minWeightFractionPerNode"], p["minInfoGain"], p["impurity"],
                      float(p["subsamplingRate"]), p["bootstrap"], int(p["seed"]))


def _blocks(rows: DataFrame, n_features: int, max_bins: int):
    """Rows (x, y, w) as stored blocks of bins, with the thresholds and (rows, classes, weight). The thresholds
    come from the values of all rows, condensed to 4,096 points a task."""
    got = (rows.mapInArrow(trees.summarise(n_features), "feature int, v binary, u binary, n long, classes int, bad long, total double")
           .groupBy("feature")
           .applyInArrow(trees.chosen(max_bins), "feature int, cuts array<double>, n long, bad long, classes int, total double").collect())
    if not got:
        raise ValueError("cannot train a forest on an empty table")
    if got[0]["bad"]:
        raise ValueError(f"{got[0]['bad']} training rows without a class, a weight or finite features")
    cuts = [np.array(r["cuts"], np.float64) for r in sorted(got, key=lambda r: r["feature"])]
    checkpoint_dir(rows.sparkSession)
    blocks = rows.mapInArrow(trees.to_blocks(cuts), "block long, n int, bins binary, y binary, w binary").checkpoint(eager=True)
    return blocks, cuts, (got[0]["n"], max(2, got[0]["classes"]), got[0]["total"])


class _Top:
    """The nodes of a forest that are split by histograms summed over all tasks."""

    def __init__(self, spec: trees.Spec):
        self.spec, self.inner, self.ends = spec, {}, {}

    def conditions(self, tree: int, path: int) -> list[tuple[int, int, int]]:
        out = []
        while path > 1:
            feat, at = self.inner[tree, path // 2]["feat"], self.inner[tree, path // 2]["bin"]
            out.append((feat, at, path % 2))
            path //= 2
        return out[::-1]

    def grow(self, blocks: DataFrame, max_rows: int, least: float) -> list[tuple[int, int]]:
        """Split until every node that is not a leaf has ``max_rows`` rows at most; returns those nodes."""
        spec, k, units = self.spec, self.spec.n_classes, []
        large = [(t, 1) for t in range(spec.n_trees)]
        while large:
            nodes = {}
            for tree, path in large:
                nodes.setdefault(tree, []).append((path, self.conditions(tree, path)))
            found = (blocks.mapInArrow(trees.node_histograms(spec, nodes), "tree int, path long, part long, h binary")
                     .groupBy("tree", "path")
                     .applyInArrow(trees.node_split(spec, least), "tree int, path long, gain double, feat int, bin int, "
                                   "left array<double>, right array<double>, both array<double>").collect())
            large = []
            for r in sorted(found, key=lambda r: (r["tree"], r["path"])):
                tree, path = r["tree"], r["path"]
                if r["gain"] <= 0:
                    self.ends[tree, path] = r["both"][:k]
                    continue
                self.inner[tree, path] = {"feat": r["feat"], "bin": r["bin"], "gained": r["gain"] * sum(r["both"][:k]), "stats": r["both"][:k]}
                for kid, (*stats, held, n) in ((2 * path, r["left"]), (2 * path + 1, r["right"])):
                    if sum(s > 0 for s in stats) < 2 or held < 2 * max(spec.min_rows, 1) or kid.bit_length() - 1 >= spec.max_depth:
                        self.ends[tree, kid] = stats
                    else:
                        (large if n > max_rows else units).append((tree, kid))
        return units

    def prune(self, says: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
        """Merge leaves of one prediction below one split; ``says`` holds the predictions of the subtrees that
        are a leaf. Returns the subtrees that are gone with it."""
        gone = []
        for tree, path in sorted(self.inner, key=lambda x: -x[1]):
            kids = [(tree, 2 * path), (tree, 2 * path + 1)]
            said = [int(np.argmax(self.ends[x])) if x in self.ends else says.get(x) for x in kids]
            if said[0] is not None and said[0] == said[1]:
                gone += [x for x in kids if x in says]
                for x in kids:
                    self.ends.pop(x, None)
                self.ends[tree, path] = self.inner.pop((tree, path))["stats"]
        return gone


def _grown(rows: DataFrame, n_features: int, params: dict, keep: bool):
    """Train on rows (x array<double>, y double, w double): the spec, the thresholds, the folder of the trees
    (None unless ``keep``), their shapes, and each tree's gain by feature."""
    spark = rows.sparkSession
    params = {k: v for k, v in params.items() if k not in ENGINE_ONLY}
    blocks, cuts, (n, classes, total) = _blocks(rows, n_features, params.get("maxBins", 32))
    spec = _spec(params, n_features, classes, n)
    least = spec.min_share * total
    cores = spark.sparkContext.defaultParallelism
    top, max_rows = _Top(spec), max(1, UNIT_BYTES // (2 * n_features + 100))
    if n <= max_rows or spec.max_depth == 0:
        tasks = min(spec.n_trees, 2 * cores)
        units = [[(t, 1, []) for t in range(u, spec.n_trees, tasks)] for u in range(tasks)]
        sent = blocks.selectExpr(f"explode(sequence(0, {tasks - 1})) AS unit", "*", "CAST(NULL AS BINARY) AS c")
    else:
        units = [[(tree, path, top.conditions(tree, path))] for tree, path in top.grow(blocks, max_rows, least)]
        tasks = min(len(units), max(2 * cores, len(units) // 8))
        sent = blocks.mapInArrow(trees.to_units(spec, units), "unit int, block long, n int, bins binary, y binary, w binary, c binary")
    path, parts = scratch_path(spark, "forest") if keep else None, []
    columns = ("tree int, path long, conditions array<int>, nodes long, depth int, says int, stats array<double>, "
               "gained array<double>, feat binary, bin binary, next binary, leaf binary")
    if units:
        out = (sent.repartitionById(tasks, "unit").sortWithinPartitions("unit", "block")
               .mapInArrow(trees.grow_units(spec, units, least, keep), columns))
        if keep:
            out.write.parquet(path)
            out = spark.read.schema(columns).parquet(path)
        parts = out.select("tree", "path", "nodes", "depth", "says", "stats", "gained").collect()
    dropped = top.prune({(r["tree"], r["path"]): r["says"] for r in parts if r["nodes"] == 1})
    if keep and (top.ends or dropped):
        ends = [trees.part_row(tree, p, top.conditions(tree, p), {"left": np.array([-1]), "feat": np.array([-1]), "bin": np.array([0]), "depth": 0,
                                                                  "stats": np.array([s]), "gained": np.zeros(n_features)}, True)
                for (tree, p), s in sorted(top.ends.items())]
        more = spark.createDataFrame(ends, columns).coalesce(1)
        whole = scratch_path(spark, "forest")
        if units:
            kept = spark.read.schema(columns).parquet(path)
            if dropped:
                kept = kept.join(F.broadcast(spark.createDataFrame(dropped, "tree int, path long")), ["tree", "path"], "left_anti")
            more = kept.select(more.columns).unionByName(more)
        more.write.parquet(whole)
        path = whole
    sizes, deep, gained = np.zeros(spec.n_trees, int), np.zeros(spec.n_trees, int), np.zeros((spec.n_trees, n_features))
    away = set(dropped)
    for r in parts:
        if (r["tree"], r["path"]) not in away:
            sizes[r["tree"]] += r["nodes"]
            deep[r["tree"]] = max(deep[r["tree"]], r["depth"] + r["path"].bit_length() - 1)
            gained[r["tree"]] += r["gained"]
    for (tree, p), node in top.inner.items():
        sizes[tree] += 1
        gained[tree, node["feat"]] += node["gained"]
    for tree, p in top.ends:
        sizes[tree] += 1
        deep[tree] = max(deep[tree], p.bit_length() - 1)
    return spec, cuts, path, [TreeShape(int(s), int(d)) for s, d in zip(sizes, deep)], gained


def train_random_forest(train: DataFrame, feature_names: list[str], label_col: str = "label",
                        balanced: bool = True, **overrides) -> ForestModel:
    """100 trees, depth 20, >= 2 rows per leaf, sqrt features, seed 42; ``overrides`` win.

    The model scores by column name.
    """
    params = {**FOREST_DEFAULTS, **overrides}
    data = train.withColumn(label_col, F.col(label_col).cast("double"))
    weight = F.lit(1.0)
    if balanced:
        data = balanced_weights(data.withColumn(label_col, F.col(label_col).cast("int")),
                                label_col, "_w").withColumn(label_col, F.col(label_col).cast("double"))
        weight = F.col("_w")
    rows = data.select(_features(feature_names).alias("x"), F.col(label_col).alias("y"), weight.alias("w"))
    spec, cuts, path, shapes, _ = _grown(rows, len(feature_names), params, keep=True)
    return ForestModel(list(feature_names), [c.tolist() for c in cuts], spec.n_classes, path, shapes)


def _features(names: list[str]):
    return F.array(*[F.col(f"`{f}`").cast("double") for f in names])


def score_random_forest(model: ForestModel | PipelineModel, df: DataFrame, feature_names: list[str]) -> DataFrame:
    """Adds ``rf_prediction`` (0/1), ``rf_probability`` (P(attack)), ``rf_confidence`` (%). Also takes the
    Spark ML pipelines of bundles saved by earlier versions."""
    cast = cast_double(df, feature_names)
    confidence = F.round(F.col("rf_probability") * 100.0, 2)
    if isinstance(model, PipelineModel):
        out = model.transform(cast)
        return (out.withColumns({"rf_prediction": F.col("_rf_pred").cast("int"),
                                 "rf_probability": vector_to_array(F.col("_rf_prob"))[1]})
                .withColumn("rf_confidence", confidence).drop("features", "_rf_pred", "_rf_prob", "_rf_raw"))
    new = ("rf_prediction", "rf_probability")
    cast = cast.drop(*new, "rf_confidence")
    schema = T.StructType([*cast.schema.fields, T.StructField(new[0], T.IntegerType()), T.StructField(new[1], T.DoubleType())])
    run = trees.scorer(model.files(df.sparkSession), [np.array(c, np.float64) for c in model.thresholds], model.classes)
    return cast.withColumn("_x", _features(model.features)).mapInArrow(run, schema).withColumn("rf_confidence", confidence)


def save_forest(model: ForestModel | PipelineModel, spark: SparkSession, path: str) -> str:
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
        return path
    spark.read.parquet(model.path).write.mode("overwrite").parquet(f"{path}/trees")
    shapes = [(t.numNodes, t.depth) for t in model.trees]
    spark.createDataFrame([(model.features, model.thresholds, model.classes, shapes)],
                          "features array<string>, thresholds array<array<double>>, classes int, shapes array<struct<n: int, depth: int>>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return path


def load_forest(spark: SparkSession, path: str) -> ForestModel | PipelineModel:
    """The trees are copied, so that a bundle can be written over while its models are in use."""
    try:
        m = spark.read.parquet(f"{path}/model").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return PipelineModel.load(path)
    own = scratch_path(spark, "forest")
    spark.read.parquet(f"{path}/trees").write.parquet(own)
    return ForestModel(list(m["features"]), [list(c) for c in m["thresholds"]], m["classes"], own,
                       [TreeShape(s["n"], s["depth"]) for s in m["shapes"]])


def forest_model(model: ForestModel) -> ForestModel:
    return model


def feature_importances(train: DataFrame, feature_names: list[str], label_col: str = "label",
                        **overrides) -> DataFrame:
    """Impurity importances of a quick 50-tree forest, all features, descending."""
    params = {**IMPORTANCE_FOREST_DEFAULTS, **overrides}
    data = to_feature_vector(train, feature_names)
    rows = data.select(vector_to_array("features").alias("x"), F.col(label_col).cast("double").alias("y"), F.lit(1.0).alias("w"))
    gained = _grown(rows, len(feature_names), params, keep=False)[-1]
    per_tree = gained.sum(axis=1, keepdims=True)          # every tree counts the same
    total = (gained / np.where(per_tree > 0, per_tree, 1.0)).sum(axis=0)
    imp = (total / (total.sum() or 1.0)).tolist()
    rows = [(f, float(v)) for f, v in zip(feature_names, imp)]
    return local_table(train.sparkSession, rows, "feature string, importance double")


def rank_importances(importances: DataFrame, top_n: int | None = None) -> DataFrame:
    out = importances.orderBy(F.col("importance").desc(), F.col("feature"))
    return out.limit(top_n) if top_n else out


def ranked_features(importances: DataFrame, top_n: int = 20) -> list[str]:
    return [r["feature"] for r in rank_importances(importances, top_n).collect()]


def training_accuracy(model: ForestModel, train: DataFrame, feature_names: list[str],
                      label_col: str = "label") -> DataFrame:
    s = score_random_forest(model, train, feature_names)
    return s.agg(F.round(F.avg((F.col("rf_prediction") == F.col(label_col)).cast("double")), 6)
                 .alias("training_accuracy"))
