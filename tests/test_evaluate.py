import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from groveline import presets as P
from groveline.operators import evaluate
from groveline.operators.columns import encode_campaign
from groveline.sources.campaign import campaign


def _scored(spark, *pairs):
    return spark.createDataFrame(
        [(float(a), float(b)) for a, b in pairs], "label double, prediction double"
    )


@pytest.fixture(scope="module")
def ruled(encoded):
    return encoded.withColumn("prediction", (F.col("duration") >= 900).cast("double")).cache()


@pytest.fixture(scope="module")
def counts(ruled):
    return evaluate.confusion_counts(ruled, P.LABEL)


def _evaluator(metric, **kw):
    return MulticlassClassificationEvaluator(labelCol=P.LABEL, metricName=metric, **kw)


def test_per_label_measures_agree_with_spark(ruled, counts):
    for row in evaluate.label_metrics(counts).collect():
        for ours, theirs in (
            ("precision", "precisionByLabel"),
            ("recall", "recallByLabel"),
            ("f1", "fMeasureByLabel"),
        ):
            want = _evaluator(theirs, metricLabel=row.label).evaluate(ruled)
            assert row[ours] == pytest.approx(want, abs=1e-12)


def test_overall_measures_agree_with_spark(ruled, counts):
    got = {r.metric: r.value for r in evaluate.metric_report(counts).collect() if r.label is None}
    for ours, theirs in (
        ("accuracy", "accuracy"),
        ("f1_micro", "accuracy"),
        ("f1_weighted", "f1"),
        ("precision_weighted", "weightedPrecision"),
        ("recall_weighted", "weightedRecall"),
    ):
        assert got[ours] == pytest.approx(_evaluator(theirs).evaluate(ruled), abs=1e-12), ours


def test_report_shape(counts):
    rows = evaluate.metric_report(counts).collect()
    assert len(rows) == 5 + 3 * 2
    assert {r.metric for r in evaluate.f_measures(counts).collect()} == {
        "accuracy", "f1_micro", "f1_weighted", "f1"
    }
    assert evaluate.precision_by_label(counts).columns == ["label", "precision"]
    assert evaluate.recall_by_label(counts).columns == ["label", "recall"]


def test_confusion_matrix_total_and_empty_cells(spark, ruled, counts):
    assert sum(r.n for r in evaluate.confusion_matrix(counts).collect()) == ruled.count()
    one_sided = evaluate.confusion_counts(_scored(spark, (0, 0), (1, 0), (1, 0)), "label")
    assert sorted(evaluate.confusion_matrix(one_sided).collect()) == [
        (0, 0, 1), (0, 1, 0), (1, 0, 2), (1, 1, 0)
    ]


def test_third_label_appears_beside_the_listed_ones(spark):
    counts = evaluate.confusion_counts(_scored(spark, (0, 0), (2, 0)), "label")
    got = {(r.label, r.prediction): r.n for r in evaluate.confusion_matrix(counts, (0, 1)).collect()}
    assert len(got) == 9 and got[2, 0] == 1 and got[1, 1] == 0


def test_no_rows(spark):
    counts = evaluate.confusion_counts(_scored(spark), "label")
    assert evaluate.confusion_matrix(counts).collect() == []
    assert [r.n for r in evaluate.confusion_matrix(counts, (0, 1)).collect()] == [0] * 4
    assert evaluate.label_metrics(counts).collect() == []
    assert evaluate.auc_hard(counts).first().auc is None


def test_too_many_classes_is_an_error(spark):
    counts = evaluate.confusion_counts(
        spark.range(20).selectExpr("cast(id as double) label", "0D prediction"), "label"
    )
    with pytest.raises(Exception, match="too many classes"):
        evaluate.confusion_matrix(counts, max_classes=10).collect()


def test_a_thousand_classes(spark):
    scored = spark.range(5000).selectExpr(
        "cast(id % 1000 as double) label", "cast((id * 7) % 1000 as double) prediction"
    )
    matrix = evaluate.confusion_matrix(evaluate.confusion_counts(scored, "label"))
    total = matrix.agg(F.count("n"), F.sum("n"), F.sum((F.col("n") > 0).cast("int"))).first()
    assert tuple(total) == (1_000_000, 5000, 1000)


def test_class_never_predicted_has_precision_zero(spark):
    counts = evaluate.confusion_counts(_scored(spark, (0, 0), (1, 0)), "label")
    rows = {r.label: r for r in evaluate.label_metrics(counts).collect()}
    assert (rows[1.0].precision, rows[1.0].recall, rows[1.0].f1) == (0.0, 0.0, 0.0)
    assert rows[0.0].precision == 0.5 and rows[0.0].recall == 1.0


def test_groups_are_measured_apart(spark):
    scored = _scored(spark, (0, 0), (1, 1)).withColumn("m", F.lit("good")).unionByName(
        _scored(spark, (0, 1), (1, 0)).withColumn("m", F.lit("bad"))
    )
    report = evaluate.metric_report(evaluate.confusion_counts(scored, "label", by=["m"]), ["m"])
    got = {r.m: r.value for r in report.where("metric = 'accuracy'").collect()}
    assert got == {"good": 1.0, "bad": 0.0}


def test_auc_hard_agrees_with_spark(spark, ruled, counts):
    evaluator = BinaryClassificationEvaluator(labelCol=P.LABEL, rawPredictionCol="prediction")
    assert evaluate.auc_hard(counts).first().auc == pytest.approx(
        evaluator.evaluate(ruled), abs=1e-12
    )
    evaluator = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="prediction")
    for pairs in ([(0, 0), (0, 1)], [(1, 0), (1, 1)], [(0, 1), (1, 0)]):
        scored = _scored(spark, *pairs)
        got = evaluate.auc_hard(evaluate.confusion_counts(scored, "label")).first().auc
        assert got == evaluator.evaluate(scored), pairs


def test_auc_score_is_the_rank_statistic(spark):
    scored = spark.createDataFrame(
        [(1.0, 0.9), (0.0, 0.8), (1.0, 0.8), (0.0, 0.1), (1.0, 0.5)], "label double, score double"
    )
    wins = [1, 1, 0.5, 1, 0, 1]
    assert evaluate.auc_score(scored, "label", "score") == pytest.approx(sum(wins) / 6)


def test_metrics_need_one_scan_of_the_rows(spark, small):
    ruled = encode_campaign(campaign(spark, small)).withColumn(
        "prediction", (F.col("duration") >= 900).cast("double")
    )
    report = evaluate.metric_report(evaluate.confusion_counts(ruled, P.LABEL))
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
