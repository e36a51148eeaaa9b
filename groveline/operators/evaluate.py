"""Measures of a classification, all but one from the confusion counts.

The counts are one aggregate over the scored rows and leave a handful of rows;
every ratio is computed from those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.operators.persist import materialised

_MAX_CLASSES = 10_000


def predictions_labels(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """The (prediction, label) pairs of a scored table."""
    return scored.select(
        F.col(prediction).cast("double").alias("prediction"),
        F.col(label).cast("double").alias("label"),
    )


def confusion_counts(
    scored: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    """Rows per (label, prediction), non-empty cells only, optionally per group of ``by``."""
    return scored.groupBy(
        *by,
        F.col(label).cast("double").alias("label"),
        F.col(prediction).cast("double").alias("prediction"),
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    counts: DataFrame, labels: Sequence[float] = (), *, max_classes: int = _MAX_CLASSES
) -> DataFrame:
    """Every (label, prediction) cell, empty ones with 0.

    The classes are those met as label or prediction, and those listed in ``labels``; more
    than ``max_classes`` of them are an error, never cut. Only their names are gathered:
    the cells stay rows, joined by a sum with a zero for each pair of classes.
    """
    listed = F.array(*[F.lit(float(v)) for v in labels]).cast("array<double>")
    met = counts.select(F.explode(F.array("label", "prediction")).alias("label")).distinct()
    gathered = met.limit(max_classes + 1).agg(F.collect_set("label").alias("met"))
    checked = gathered.select(
        F.when(F.size("met") <= max_classes, F.array_union("met", listed))
        .otherwise(F.raise_error(F.lit("too many classes for a confusion matrix")))
        .alias("classes")
    )
    zeros = checked.select("classes", F.explode("classes").alias("label")).select(
        "label",
        F.explode("classes").alias("prediction"),
        F.lit(0).cast("bigint").alias("n"),
    )
    cells = counts.select("label", "prediction", "n").unionByName(zeros)
    return cells.groupBy("label", "prediction").agg(F.sum("n").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is empty."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def label_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: rows, predicted rows, hits, precision, recall and F1."""
    zero = F.lit(0).cast("bigint")
    n = F.col("n")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)

    def share(of: str, n_label: Column, n_predicted: Column, n_hit: Column) -> Column:
        return F.struct(
            F.col(of).alias("label"),
            n_label.alias("n_label"),
            n_predicted.alias("n_predicted"),
            n_hit.alias("n_hit"),
        )

    shares = F.array(share("label", n, zero, hit), share("prediction", zero, n, zero))
    totals = (
        counts.select(*by, F.inline(shares))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("n_label", "n_predicted", "n_hit")])
    )
    precision = _ratio(F.col("n_hit"), F.col("n_predicted"))
    recall = _ratio(F.col("n_hit"), F.col("n_label"))
    return totals.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1",
        _ratio(
            2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
        ),
    )


def precision_by_label(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return label_metrics(counts, by).select(*by, "label", "precision")


def recall_by_label(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return label_metrics(counts, by).select(*by, "label", "recall")


def _overall(per_label: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = F.sum("n_label")
    accuracy = _ratio(F.sum("n_hit"), rows)
    return per_label.groupBy(*by).agg(
        accuracy.alias("accuracy"),
        # each row has one label and one prediction, so micro F1 is the accuracy
        accuracy.alias("f1_micro"),
        _ratio(F.sum(F.col("f1") * F.col("n_label")), rows).alias("f1_weighted"),
        _ratio(F.sum(F.col("precision") * F.col("n_label")), rows).alias("precision_weighted"),
        _ratio(F.sum(F.col("recall") * F.col("n_label")), rows).alias("recall_weighted"),
        F.collect_list(F.struct("label", "precision", "recall", "f1")).alias("classes"),
    )


_OVERALL = ("accuracy", "f1_micro", "f1_weighted", "precision_weighted", "recall_weighted")


def _long(
    counts: DataFrame, by: Sequence[str], overall: Sequence[str], per_class: Sequence[str]
) -> DataFrame:
    none = F.lit(None).cast("double")
    whole = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), none.alias("label"), F.col(m).alias("value"))
            for m in overall
        ]
    )

    def of_each_class(metric: str) -> Column:
        return F.transform(
            "classes",
            lambda c: F.struct(
                F.lit(metric).alias("metric"), c["label"].alias("label"), c[metric].alias("value")
            ),
        )

    report = _overall(label_metrics(counts, by), by)
    return report.select(*by, F.inline(F.concat(whole, *map(of_each_class, per_class))))


def f_measures(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F measures as (metric, label, value): accuracy, micro, weighted, and per class."""
    return _long(counts, by, ("accuracy", "f1_micro", "f1_weighted"), ("f1",))


def metric_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every measure as (metric, label, value), per group of ``by``; label is null for overall ones."""
    return _long(counts, by, _OVERALL, ("precision", "recall", "f1"))


def auc_hard(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve of the hard 0/1 predictions: balanced accuracy.

    Without negatives the area is 1, without positives 0, without rows null.
    """
    positive, hit = F.col("label") == 1.0, F.col("label") == F.col("prediction")

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    p, q = rows(positive), rows(~positive)
    area = (
        F.when((p == 0) & (q == 0), F.lit(None).cast("double"))
        .when(q == 0, F.lit(1.0))
        .when(p == 0, F.lit(0.0))
        .otherwise((rows(positive & hit) / p + rows(~positive & hit) / q) / 2)
    )
    return counts.groupBy(*by).agg(area.alias("auc"))


def auc_score(scored: DataFrame, label: str, score: str = "rawPrediction") -> float:
    """Area under the ROC curve of a real-valued or raw score, with no thinning of the curve.

    The sort reads its input twice, so labels and scores are kept meanwhile.
    """
    evaluator = BinaryClassificationEvaluator(
        labelCol=label, rawPredictionCol=score, metricName="areaUnderROC", numBins=0
    )
    with materialised(scored.select(label, score)) as kept:
        return evaluator.evaluate(kept)
