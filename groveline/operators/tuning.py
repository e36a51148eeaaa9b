"""Depth search by k-fold cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.operators import boosting
from groveline.operators.evaluate import auc_hard
from groveline.operators.features import assemble, assembler
from groveline.operators.models import SEED, classifier, tree_pipeline
from groveline.operators.persist import materialised
from groveline.operators.rules import tree_nodes
from groveline.sources.scratch import shared_dir

# What the depth path honours as the estimator does; others may change its predictions.
_HONOURED = {
    "impurity", "maxBins", "minInstancesPerNode", "minInfoGain", "minWeightFractionPerNode",
    "maxMemoryInMB", "cacheNodeIds", "checkpointInterval",
}
# The same for a forest, whose draws of rows and features do not depend on its depth.
_HONOURED_FOREST = _HONOURED | {"numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap"}
# What ``boosting`` honours; how Spark keeps nodes and errors changes no tree.
_HONOURED_BOOSTING = {"maxIter", "stepSize", "maxBins", "maxMemoryInMB", "cacheNodeIds", "checkpointInterval"}
# Rows collected of a fold are at most four for each of 2^depth leaves.
DEEPEST = 14

# The depths tried and the number of folds.
DEPTHS = [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
FOLDS = 3


@dataclass
class Search:
    """Outcome of a depth search."""

    depths: list[int]
    average: list[float]
    best_depth: int
    best_model: PipelineModel

    def table(self, like: DataFrame) -> DataFrame:
        """One row per depth: mean AUC over the folds, and whether it was chosen."""
        rows = [(d, a, d == self.best_depth) for d, a in zip(self.depths, self.average)]
        return like.sparkSession.createDataFrame(
            rows, "max_depth int, avg_auc double, chosen boolean"
        )


def grid(estimator, depths: Sequence[int] = DEPTHS) -> list:
    return ParamGridBuilder().addGrid(estimator.maxDepth, list(depths)).build()


def cross_validate(
    train: DataFrame,
    kind: str,
    label: str,
    features: Sequence[str],
    *,
    fold: str = "fold",
    depths: Sequence[int] = DEPTHS,
    folds: int = FOLDS,
    parallelism: int = 4,
    seed: int = SEED,
    **params,
) -> Search:
    """Fit every depth on every fold, keep the depth with the best mean AUC, refit on all rows.

    Only the columns used are kept. Fits of all folds run side by side, the deepest first, since
    they last longest. Boosting carries the trees so far in the lineage of its errors, which
    every task reads; unless ``checkpointInterval`` is given it is cut after each tree, wherever a
    shared checkpoint folder is named.
    """
    shared_dir(train.sparkSession, required=False)
    if kind == "gbt":
        params = {"checkpointInterval": 1, **params}
    pipeline = tree_pipeline(kind, label, features, seed=seed, **params)
    evaluator = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="prediction")
    maps = dict(zip(depths, grid(pipeline.getStages()[-1], depths)))
    with materialised(train.select(*features, label, fold)) as kept:

        def one_fit(depth: int, i: int) -> float:
            held_out = F.col(fold) == i
            model = pipeline.fit(kept.where(~held_out), maps[depth])
            return evaluator.evaluate(model.transform(kept.where(held_out)))

        pairs = [(d, i) for d in sorted(depths, reverse=True) for i in range(folds)]
        areas = dict(zip(pairs, _side_by_side(train.sparkSession, one_fit, pairs, parallelism)))
        average = [float(np.mean([areas[d, i] for i in range(folds)])) for d in depths]
        best = max(range(len(average)), key=average.__getitem__)
        model = pipeline.fit(kept, maps[depths[best]])
    return Search(list(depths), average, depths[best], model)


def _side_by_side(spark, work, arguments: Sequence[tuple], parallelism: int) -> list:
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        tasks = [pool.submit(inheritable_thread_target(spark)(work), *a) for a in arguments]
        return [task.result() for task in tasks]


def _mean_areas(spark, cells: list[tuple], depths: Sequence[int]) -> list[float]:
    """The mean over the folds, in their order, of the area of each depth's confusion counts."""
    counts = spark.createDataFrame(
        cells, "fold int, max_depth int, label double, prediction double, n bigint"
    )
    areas = auc_hard(counts, by=["fold", "max_depth"]).orderBy("fold").collect()
    return [float(np.mean([r.auc for r in areas if r.max_depth == d])) for d in depths]


def _leaf_paths(rules: str) -> list[list[int]]:
    """For each leaf, left to right, its nodes from the root down, numbered in rule order.

    In the rule text a line is indented by two plus the depth of its node.
    """
    paths: list[list[int]] = []
    above: list[int] = []
    nodes = 0
    for line in rules.splitlines()[1:]:
        text = line.lstrip()
        depth = len(line) - len(text) - 2
        if text.startswith("If"):
            above = [*above[:depth], nodes]
        elif text.startswith("Predict"):
            paths.append([*above[:depth], nodes])
        else:
            continue
        nodes += 1
    return paths


def _truncated_confusions(
    paths: list[list[int]], leaf_counts: list, depths: Sequence[int]
) -> list[tuple[int, float, float, int]]:
    """Validation counts (depth, label, prediction, n) of the tree cut off at each depth.

    ``leaf_counts`` holds (leaf, label, held_out, n). A node of the cut-off tree predicts
    the more frequent label of the training rows below it, the smaller one on a tie.
    """
    node_rows: dict[int, list[int]] = {}
    for leaf, label, held_out, n in leaf_counts:
        if not held_out:
            for node in paths[int(leaf)]:
                node_rows.setdefault(node, [0, 0])[int(label)] += n
    cells: dict[tuple, int] = {}
    for leaf, label, held_out, n in leaf_counts:
        if held_out:
            path = paths[int(leaf)]
            for depth in depths:
                no, yes = node_rows[path[min(depth, len(path) - 1)]]
                cell = (depth, float(label), 1.0 if yes > no else 0.0)
                cells[cell] = cells.get(cell, 0) + n
    return [(*cell, n) for cell, n in cells.items()]


def depth_path(
    train: DataFrame,
    label: str,
    features: Sequence[str],
    *,
    fold: str = "fold",
    depths: Sequence[int] = DEPTHS,
    folds: int = FOLDS,
    parallelism: int = 3,
    seed: int = SEED,
    **params,
) -> Search:
    """The search of ``cross_validate`` for a single decision tree, from one fit per fold.

    A decision tree grows level by level, so the tree of depth d is the deepest tree cut
    off at d. One fit per fold therefore evaluates every depth: the rows of a fold are
    counted by leaf, at most 2^depth leaves, and the counts are added up the tree.
    Binary labels 0 and 1. Parameters that could change predictions otherwise, and depths
    above ``DEEPEST``, are refused: ``cross_validate`` takes those.
    """
    other = sorted(set(params) - _HONOURED)
    if other:
        raise ValueError(f"the depth path does not honour {', '.join(other)}")
    if max(depths) > DEEPEST:
        raise ValueError(f"the depth path goes down to depth {DEEPEST}")
    spark = train.sparkSession
    shared_dir(spark, required=False)
    deepest = max(depths)

    with materialised(train.select(*features, label, fold)) as kept:
        vectors = assemble(kept, features)

        def one_fold(i: int) -> list[tuple]:
            held_out = F.col(fold) == i
            tree = classifier(
                "dt", label, seed=seed, maxDepth=deepest, leafCol="leaf", **params
            ).fit(vectors.where(~held_out))
            counts = (
                tree.transform(vectors)
                .groupBy("leaf", label, held_out.alias("held_out"))
                .agg(F.count(F.lit(1)).alias("n"))
                .collect()
            )
            paths = _leaf_paths(tree.toDebugString)
            # a binary tree has one leaf more than it has splits
            if 2 * len(paths) - 1 != tree.numNodes:
                raise RuntimeError("the printed rules do not tell the leaves of the tree")
            found = _truncated_confusions(paths, counts, depths)
            return [(i, *row) for row in found]

        found = _side_by_side(spark, one_fold, [(i,) for i in range(folds)], parallelism)
        average = _mean_areas(spark, [row for rows in found for row in rows], depths)
        best = max(range(len(average)), key=average.__getitem__)
        final = tree_pipeline("dt", label, features, seed=seed, maxDepth=depths[best], **params)
        model = final.fit(kept)
    return Search(list(depths), average, depths[best], model)


def forest_has_path(
    features: Sequence[str], depths: Sequence[int], *, numTrees: int = 20, maxBins: int = 32,
    maxMemoryInMB: int = 256, **params,
) -> bool:
    """Whether ``forest_path`` gives what ``cross_validate`` does.

    Features are drawn node by node, level after level, while a level of all trees fits the
    memory of a training step; where it does not, the order of the draws depends on the depth.
    """
    level = 8 * 2 * maxBins * len(features) * numTrees * 2 ** (max(depths) - 1)
    honoured = not set(params) - _HONOURED_FOREST
    return honoured and max(depths) <= DEEPEST and level <= maxMemoryInMB * 2**20


def _cut_shares(tree: list, depths: Sequence[int]) -> np.ndarray:
    """Shares of the classes by leaf, left to right, depth, and class, of a tree cut off at each depth.

    ``tree`` holds the nodes, a parent before its children and left before right. As in training, sister
    leaves of the cut-off tree that predict the same are merged into their parent.
    """
    stats = np.array([n.stats for n in tree], dtype="float64")
    totals = stats.sum(axis=1, keepdims=True)
    shares = np.divide(stats, totals, out=np.zeros_like(stats), where=totals != 0)
    level, parent = [0] * len(tree), [0] * len(tree)
    for i, n in enumerate(tree):
        if n.left is not None:
            for child in (n.left, n.right):
                level[child], parent[child] = level[i] + 1, i
    leaves = [i for i, n in enumerate(tree) if n.left is None]
    found = np.empty((len(leaves), len(depths), stats.shape[1]))
    for k, depth in enumerate(depths):
        ends: list[bool] = [True] * len(tree)
        says = [n.prediction for n in tree]
        for i in reversed(range(len(tree))):
            n = tree[i]
            if n.left is not None and level[i] < depth:
                ends[i] = ends[n.left] and ends[n.right] and says[n.left] == says[n.right]
                if ends[i]:
                    says[i] = says[n.left]
        at = list(range(len(tree)))
        for i in range(1, len(tree)):
            if ends[parent[i]]:
                at[i] = at[parent[i]]
        found[:, k] = shares[[at[i] for i in leaves]]
    return found


def _forest_cells(scored: DataFrame, label: str, shares: list[np.ndarray], depths: Sequence[int]) -> DataFrame:
    """Counts (depth, label, prediction, n) of a forest cut off at each depth, from its rows' leaves."""
    trees, tried = len(shares), list(depths)

    def count(batches):
        cells = np.zeros((len(tried), 2, 2), dtype="int64")
        for batch in batches:
            reached = batch.column("leaves").flatten().to_numpy(zero_copy_only=False)
            reached = reached.astype("int64").reshape(-1, trees)
            votes = np.zeros((len(reached), len(tried), 2))
            for t in range(trees):  # added tree by tree, as the model does
                votes += shares[t][reached[:, t]]
            yes = votes[:, :, 1] > votes[:, :, 0]
            actual = batch.column("label").to_numpy(zero_copy_only=False).astype("int64")
            for k in range(len(tried)):
                cells[k] += np.bincount(actual * 2 + yes[:, k], minlength=4).reshape(2, 2)
        at = [(k, y, p) for k in range(len(tried)) for y in (0, 1) for p in (0, 1) if cells[k, y, p]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([tried[k] for k, _, _ in at], pa.int32()),
                pa.array([float(y) for _, y, _ in at], pa.float64()),
                pa.array([float(p) for _, _, p in at], pa.float64()),
                pa.array([int(cells[x]) for x in at], pa.int64()),
            ],
            names=["max_depth", "label", "prediction", "n"],
        )

    narrow = scored.select(vector_to_array("leaf").alias("leaves"), F.col(label).cast("double").alias("label"))
    partial = narrow.mapInArrow(count, "max_depth int, label double, prediction double, n bigint")
    return partial.groupBy("max_depth", "label", "prediction").agg(F.sum("n").alias("n"))


def forest_path(
    train: DataFrame,
    label: str,
    features: Sequence[str],
    *,
    fold: str = "fold",
    depths: Sequence[int] = DEPTHS,
    folds: int = FOLDS,
    parallelism: int = 3,
    seed: int = SEED,
    **params,
) -> Search:
    """The search of ``cross_validate`` for a random forest, from one fit per fold.

    A forest draws its rows before it grows, and the features of its nodes level by level, so
    the forest of depth d is the deepest one with every tree cut off at d. The rows of the fold
    held out are told the leaves they reach, once; the votes at every depth follow from the
    nodes above those. Binary labels 0 and 1. What ``forest_has_path`` denies is refused:
    ``cross_validate`` takes that.
    """
    if not forest_has_path(features, depths, **params):
        raise ValueError("the depth path does not hold for these parameters")
    spark = train.sparkSession
    shared_dir(spark, required=False)

    with materialised(train.select(*features, label, fold)) as kept:
        vectors = assemble(kept, features)

        def one_fold(i: int) -> list[tuple]:
            held_out = F.col(fold) == i
            forest = classifier(
                "rf", label, seed=seed, maxDepth=max(depths), leafCol="leaf", **params
            ).fit(vectors.where(~held_out))
            trees: dict[int, list] = {}
            for node in tree_nodes(spark, forest).orderBy("tree", "node").collect():
                trees.setdefault(node.tree, []).append(node)
            shares = [_cut_shares(trees[t], depths) for t in sorted(trees)]
            scored = forest.transform(vectors.where(held_out))
            return [(i, *row) for row in _forest_cells(scored, label, shares, depths).collect()]

        found = _side_by_side(spark, one_fold, [(i,) for i in range(folds)], parallelism)
        average = _mean_areas(spark, [row for rows in found for row in rows], depths)
        best = max(range(len(average)), key=average.__getitem__)
        final = tree_pipeline("rf", label, features, seed=seed, maxDepth=depths[best], **params)
        model = final.fit(kept)
    return Search(list(depths), average, depths[best], model)


def boosting_has_path(train: DataFrame, features: Sequence[str], depths: Sequence[int], **params) -> bool:
    """Whether ``boosted_path`` gives what ``cross_validate`` does."""
    honoured = not set(params) - _HONOURED_BOOSTING and params.get("maxBins", 32) <= boosting.MOST_BINS
    nominal = boosting.has_nominal(assemble(train, features))
    return honoured and not nominal and min(depths) >= 1 and max(depths) <= boosting.DEEPEST


def boosted_path(
    train: DataFrame,
    label: str,
    features: Sequence[str],
    *,
    fold: str = "fold",
    depths: Sequence[int] = DEPTHS,
    folds: int = FOLDS,
    parallelism: int = 4,
    seed: int = SEED,
    **params,
) -> Search:
    """The search of ``cross_validate`` for boosted trees, all folds of a depth in the same passes.

    Every depth is boosted on every fold. Trees are grown by ``boosting`` on rows binned once; the
    first tree of a fold, which learns the labels, is that of the greatest depth cut off. Depths run
    side by side, the deepest first. The best depth is boosted on all rows. Binary labels 0
    and 1. What ``boosting_has_path`` denies is refused: ``cross_validate`` takes that.
    """
    if not boosting_has_path(train, features, depths, **params):
        raise ValueError("the boosted path does not hold for these parameters")
    spark = train.sparkSession
    shared_dir(spark)
    estimator = classifier("gbt", label, seed=seed, **params)
    told = {
        "iterations": estimator.getMaxIter(), "step_size": estimator.getStepSize(),
        "interval": estimator.getCheckpointInterval(),
    }

    with materialised(train.select(*features, label, fold)) as kept:
        vectors = assemble(kept, features)
        in_fold = dict(kept.groupBy(fold).count().collect())
        rows = sum(in_fold.values())
        sizes = {i: rows - in_fold.get(i, 0) for i in range(-1, folds)}
        if not all(sizes.values()):
            raise ValueError("a fold leaves no rows to train on")

        def cuts(i: int) -> list:
            used = vectors if i < 0 else vectors.where(F.col(fold) != i)
            return boosting.candidates(used, sizes[i], estimator.getMaxBins(), seed)

        everything, *of_folds = _side_by_side(spark, cuts, [(i,) for i in range(-1, folds)], parallelism)
        sets, whole, size = dict(enumerate(of_folds)), {-1: everything}, {-1: sizes.pop(-1)}

        with boosting.kept_blocks(vectors, label, fold, sets, rows) as blocks:
            first = boosting.grow(blocks, None, sets, sizes, max(depths))

            def one_depth(depth: int) -> list[tuple]:
                boosted = boosting.boost(spark, blocks, sets, sizes, depth, first, **told)
                found = boosting.held_out_counts(blocks, boosted, depth)
                return [(i, depth, *cell) for i, *cell in found]

            deepest_first = [(d,) for d in sorted(depths, reverse=True)]
            found = _side_by_side(spark, one_depth, deepest_first, parallelism)
        average = _mean_areas(spark, [row for rows in found for row in rows], depths)
        best = depths[max(range(len(average)), key=average.__getitem__)]
        with boosting.kept_blocks(vectors, label, fold, whole, rows) as blocks:
            first = boosting.grow(blocks, None, whole, size, best)
            boosted = boosting.boost(spark, blocks, whole, size, best, first, **told)[-1]
        estimator.setMaxDepth(best)
        model = boosting.as_model(spark, estimator, boosted, everything, best)
    return Search(list(depths), average, best, PipelineModel([assembler(features), model]))
