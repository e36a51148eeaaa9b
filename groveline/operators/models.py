"""Tree classifiers: presets, pipelines, scoring, and what a fitted model looks like."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    RandomForestClassifier,
)
from pyspark.sql import DataFrame, SparkSession

from groveline.operators.features import assembler
from groveline.operators.persist import materialised
from groveline.sources.scratch import shared_dir

_CLASSIFIERS = {
    "dt": DecisionTreeClassifier,
    "rf": RandomForestClassifier,
    "gbt": GBTClassifier,
}

# The parameters of the two presets.
SHALLOW = {
    "dt": {"maxDepth": 2, "maxBins": 32, "impurity": "gini"},
    "rf": {
        "numTrees": 3, "maxDepth": 2, "maxBins": 32, "impurity": "gini",
        "featureSubsetStrategy": "auto",
    },
    "gbt": {"maxIter": 3, "maxDepth": 3, "maxBins": 32, "stepSize": 0.1},
}
DEFAULT = {"dt": {}, "rf": {"numTrees": 10}, "gbt": {"maxIter": 10}}

# One split.
STUMP = {"maxDepth": 1, "maxBins": 32}

SEED = 42


def classifier(kind: str, label: str, features: str = "features", *, seed: int = SEED, **params):
    """An estimator of the given kind; other parameters keep Spark's defaults."""
    return _CLASSIFIERS[kind](labelCol=label, featuresCol=features, seed=seed, **params)


def tree_pipeline(
    kind: str, label: str, features: Sequence[str], *, seed: int = SEED, **params
) -> Pipeline:
    """Assembler and classifier as one estimator."""
    return Pipeline(stages=[assembler(features), classifier(kind, label, seed=seed, **params)])


def fit(
    train: DataFrame,
    kind: str,
    label: str,
    features: Sequence[str],
    *,
    seed: int = SEED,
    params: Mapping | None = None,
) -> PipelineModel:
    """Fit the pipeline.

    Training reads its rows several times, so the columns it uses are kept meanwhile: as
    plain columns, which the cache compresses, not as vectors, which it cannot. Boosting
    builds a long lineage, which Spark cuts wherever a shared checkpoint folder is named.
    """
    shared_dir(train.sparkSession, required=False)
    pipeline = tree_pipeline(kind, label, features, seed=seed, **(params or {}))
    with materialised(train.select(*features, label)) as kept:
        return pipeline.fit(kept)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add features, rawPrediction, probability and prediction to every row."""
    return model.transform(rows)


def tree_model(model):
    """The classifier of a fitted pipeline, or a bare fitted classifier itself."""
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def _trees(model) -> list:
    return list(getattr(model, "trees", [model]))


def tree_rules(spark: SparkSession, model) -> DataFrame:
    """The rules of every tree as (tree, line_no, text) rows."""
    rows = [
        (t, n, line.strip())
        for t, tree in enumerate(_trees(tree_model(model)))
        for n, line in enumerate(tree.toDebugString.strip().splitlines()[1:])
    ]
    return spark.createDataFrame(rows, "tree int, line_no int, text string")


def model_summary(spark: SparkSession, model) -> DataFrame:
    """One row: greatest depth, nodes in all trees, number of trees and of features."""
    fitted = tree_model(model)
    trees = _trees(fitted)
    row = (
        max(t.depth for t in trees),
        sum(t.numNodes for t in trees),
        len(trees),
        fitted.numFeatures,
    )
    return spark.createDataFrame([row], "depth int, num_nodes int, num_trees int, num_features int")
