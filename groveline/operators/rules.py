"""The nodes of fitted trees as a table, and scoring by those nodes in plain expressions."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.operators.models import tree_model
from groveline.sources.scratch import fresh_path, remove

_NODE = (
    "struct<feature:int,threshold:double,categories:array<double>,left:int,right:int,"
    "prediction:double,shares:array<double>>"
)


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    """(tree, node, feature, threshold, categories, left, right, prediction, n_rows, stats).

    One row per node, as Spark writes a model. A leaf has neither feature nor children.
    A split on a nominal feature has the categories that go left instead of a threshold.
    ``stats`` are a classifier's training rows by class, or count, sum and sum of squares.
    """
    fitted = tree_model(model)
    path = fresh_path(spark, "model")
    fitted.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    # a single tree has no number, and its columns stand by themselves
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.select(F.lit(0).alias("tree"), "*")
    is_leaf, nominal = F.col("leftChild") < 0, F.col("split.numCategories") >= 0
    values = F.col("split.leftCategoriesOrThreshold")
    found = saved.select(
        "tree",
        F.col("id").alias("node"),
        F.when(~is_leaf, F.col("split.featureIndex")).alias("feature"),
        F.when(~is_leaf & ~nominal, F.get(values, F.lit(0))).alias("threshold"),
        F.when(~is_leaf & nominal, values).alias("categories"),
        F.when(~is_leaf, F.col("leftChild")).alias("left"),
        F.when(~is_leaf, F.col("rightChild")).alias("right"),
        "prediction",
        F.col("rawCount").alias("n_rows"),
        F.col("impurityStats").alias("stats"),
    )
    # no more rows than the driver holds of the model already
    rows = spark.createDataFrame(found.orderBy("tree", "node").collect(), found.schema)
    remove(spark, path)
    return rows


def _constant(nodes: DataFrame) -> tuple[Column, int]:
    """All nodes as one constant, an array of trees, and the greatest number of splits above a leaf."""
    trees: dict[int, list] = {}
    for r in nodes.orderBy("tree", "node").collect():
        total = sum(r.stats)
        node = {
            "feature": r.feature, "threshold": r.threshold, "categories": r.categories, "left": r.left,
            "right": r.right, "prediction": r.prediction,
            "shares": [s / total if total else 0.0 for s in r.stats],
        }
        trees.setdefault(r.tree, []).append(node)
    told = json.dumps(list(trees.values()))
    return F.from_json(F.lit(told), f"array<array<{_NODE}>>"), max(map(_height, trees.values()), default=0)


def _height(tree: list[dict]) -> int:
    height = [0] * len(tree)
    for i in reversed(range(len(tree))):  # children come after their parent
        if tree[i]["feature"] is not None:
            height[i] = 1 + max(height[tree[i]["left"]], height[tree[i]["right"]])
    return height[0]


def leaves(nodes: DataFrame, features: Column) -> Column:
    """The leaf (prediction, shares of the classes) that a row reaches in every tree.

    The nodes are a constant, so this is one expression over the features, an array of
    doubles, whatever the number and depth of the trees.
    """
    trees, height = _constant(nodes)

    def leaf(tree: Column) -> Column:
        def step(at: Column, _: Column) -> Column:
            node = F.get(tree, at)
            value = F.get(features, node["feature"])
            goes_left = F.coalesce(value <= node["threshold"], F.array_contains(node["categories"], value))
            return F.when(node["feature"].isNull(), at).when(goes_left, node["left"]).otherwise(node["right"])

        levels = F.sequence(F.lit(1), F.lit(height)) if height else F.array().cast("array<int>")
        return F.get(tree, F.aggregate(levels, F.lit(0), step))

    return F.transform(trees, leaf)


def replay(spark: SparkSession, model, rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``votes``, ``raw`` and ``prediction`` from the nodes of the fitted trees.

    ``votes`` is what every tree says: for a boosted model its number, else the share of
    the second class in the leaf reached. ``raw`` holds a value for each class: of a
    forest the sums of the trees' shares, of a boosted model the margin and its negative.
    The greater one, the first of equals, is the prediction. No model runs.
    """
    fitted = tree_model(model)
    reached = leaves(tree_nodes(spark, model), F.array(*[F.col(f"`{n}`").cast("double") for n in names]))
    if isinstance(fitted, GBTClassificationModel):
        weights = F.from_json(F.lit(json.dumps(list(fitted.treeWeights))), "array<double>")
        votes = F.zip_with(F.transform("__leaves", lambda x: x["prediction"]), weights, lambda p, w: p * w)
        margin = F.aggregate(votes, F.lit(0.0), lambda s, x: s + x)
        raw = F.transform(F.array(margin), lambda m: F.array(-m, m))[0]
    else:
        votes = F.transform("__leaves", lambda x: F.get(x["shares"], F.lit(1)))
        raw = F.array(*[_class_sum(c) for c in range(fitted.numClasses)])
    scored = rows.withColumn("__leaves", reached).withColumns({"votes": votes, "raw": raw}).drop("__leaves")
    first = F.array_position("raw", F.array_max("raw")) - 1
    return scored.withColumn("prediction", first.cast("double"))


def _class_sum(number: int) -> Column:
    return F.aggregate("__leaves", F.lit(0.0), lambda s, x: s + F.get(x["shares"], F.lit(number)))
