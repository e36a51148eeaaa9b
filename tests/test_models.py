import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from groveline import presets as P
from groveline.operators import evaluate, features, models
from groveline.plans import campaign as plans


@pytest.fixture(scope="module")
def train(encoded):
    return plans.training_rows(plans.train_test(encoded)[0], layout=4).cache()


@pytest.fixture(scope="module")
def test_rows(encoded):
    return plans.train_test(encoded)[1].cache()


def _predictions(model, rows):
    return [r[1] for r in models.score(model, rows).select(P.KEY, "prediction").orderBy(P.KEY).collect()]


def test_vector_follows_the_feature_list_not_the_table(encoded):
    shuffled = encoded.select(P.LABEL, *reversed(P.FEATURES), P.KEY)
    got = features.features_as_array(features.assemble(shuffled, P.FEATURES)).first()
    assert got.features == [float(got[c]) for c in P.FEATURES]


def test_labelled_points(encoded):
    points = features.labelled_points(encoded, P.LABEL, P.FEATURES)
    assert points.columns == [P.LABEL, "features"]
    assert points.count() == encoded.count()


def test_null_feature_fails(encoded):
    broken = encoded.withColumn("age", F.when(F.col("age") > 40, F.col("age")))
    with pytest.raises(Exception, match="null"):
        features.assemble(broken, P.FEATURES).select(vector_to_array("features")).collect()


def test_nominal_features_split_on_sets(encoded):
    rows = encoded.select(*P.FEATURES, F.col("housing").alias("y"))
    marked = features.declare_nominal(rows, P.NOMINAL)
    nominal = models.fit(marked, "dt", "y", P.FEATURES, params={"maxDepth": 1})
    ordered = models.fit(rows, "dt", "y", P.FEATURES, params={"maxDepth": 1})
    assert "in {" in models.tree_model(nominal).toDebugString
    assert "<= 0.5" in models.tree_model(ordered).toDebugString


def test_presets_reach_the_estimators():
    for kind, preset in models.SHALLOW.items():
        estimator = models.classifier(kind, P.LABEL, **preset)
        for name, value in preset.items():
            assert estimator.getOrDefault(name) == value
    tree = models.classifier("dt", P.LABEL)
    assert (tree.getMaxDepth(), tree.getMaxBins(), tree.getImpurity()) == (5, 32, "gini")
    assert models.classifier("rf", P.LABEL, **models.DEFAULT["rf"]).getNumTrees() == 10
    assert models.classifier("gbt", P.LABEL, **models.DEFAULT["gbt"]).getMaxIter() == 10


@pytest.mark.parametrize("kind", ["dt", "rf", "gbt"])
def test_scoring_keeps_rows_and_repeats(train, test_rows, kind):
    model = models.fit(train, kind, P.LABEL, P.FEATURES, params=models.SHALLOW[kind])
    again = models.fit(train, kind, P.LABEL, P.FEATURES, params=models.SHALLOW[kind])
    first = _predictions(model, test_rows)
    assert len(first) == test_rows.count()
    assert set(first) <= {0.0, 1.0}
    assert first == _predictions(again, test_rows)
    scored = models.score(model, test_rows)
    assert {"rawPrediction", "probability", "prediction"} <= set(scored.columns)
    counts = evaluate.confusion_counts(scored, P.LABEL)
    hard = evaluate.auc_hard(counts).first().auc
    # a single shallow tree of three may miss the signal, the others may not
    assert hard > (0.7 if kind == "rf" else 0.85)
    assert 0.8 < evaluate.auc_score(scored, P.LABEL) <= 1.0


def test_dataframe_models_agree_with_the_row_based_api(spark, train, test_rows):
    """The shallow tree and the boosted trees against the older interface."""
    from pyspark.mllib.regression import LabeledPoint
    from pyspark.mllib.tree import DecisionTree, GradientBoostedTrees

    points = train.select(P.LABEL, *P.FEATURES).rdd.map(lambda r: LabeledPoint(r[0], list(r)[1:]))
    rows = test_rows.orderBy(P.KEY).select(*P.FEATURES).rdd.map(list)

    marked = features.declare_nominal(train, P.NOMINAL)
    ours = models.fit(marked, "dt", P.LABEL, P.FEATURES, params=models.SHALLOW["dt"])
    nominal = {P.FEATURES.index(c): 2 for c in P.NOMINAL}
    theirs = DecisionTree.trainClassifier(
        points, numClasses=2, maxDepth=2, categoricalFeaturesInfo=nominal, impurity="gini", maxBins=32
    )
    assert _predictions(ours, test_rows) == theirs.predict(rows).collect()

    ours = models.fit(train, "gbt", P.LABEL, P.FEATURES, params=models.SHALLOW["gbt"])
    theirs = GradientBoostedTrees.trainClassifier(
        points, categoricalFeaturesInfo={}, numIterations=3
    )
    assert _predictions(ours, test_rows) == theirs.predict(rows).collect()


def test_rules_and_summary(spark, train):
    forest = models.fit(train, "rf", P.LABEL, P.FEATURES, params=models.SHALLOW["rf"])
    rules = models.tree_rules(spark, forest).collect()
    assert {r.tree for r in rules} == {0, 1, 2}
    assert all(r.text.startswith(("If", "Else", "Predict")) for r in rules)
    summary = models.model_summary(spark, forest).first()
    assert summary.depth <= 2 and summary.num_trees == 3 and summary.num_features == 15
    # one line per leaf and two per split
    splits = sum(r.text.startswith("If") for r in rules)
    assert len(rules) == summary.num_nodes + splits


def test_label_metadata_saves_the_class_count_scan(spark, train):
    assert train.schema[P.LABEL].metadata["ml_attr"]["vals"] == P.YES_NO


def test_one_class(train, test_rows):
    model = models.fit(train.where("deposit = 0"), "dt", P.LABEL, P.FEATURES)
    assert set(_predictions(model, test_rows)) == {0.0}


def test_compare_reports_both_datasets(encoded):
    report = plans.compare(encoded, "dt", models.STUMP, balances=("none", "train_only"))
    rows = report.collect()
    assert {r.dataset for r in rows} == {"unbalanced", "balanced_train"}
    assert len(rows) == 2 * 11 and all(0 <= r.value <= 1 for r in rows)


@pytest.mark.parametrize("keep,most", [("none", 99), ("cache", 1), ("checkpoint", 1)])
def test_keep_reads_the_source_once(spark, encoded, keep, most):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    source = encoded.mapInPandas(counted, encoded.schema)
    n = encoded.count()
    before = read.value
    _, scored = plans.train_and_score(
        source, "dt", models.STUMP, balance="before_split", keep=keep
    )
    times = (read.value - before) / n
    assert (times <= most) and (times >= 1)
    assert keep != "none" or times > 1
    assert scored.count() > 0


def test_plans_keep_by_default_and_leave_the_callers_cache(spark, encoded):
    own = encoded.withColumn("extra", F.lit(1)).cache()
    plans.train_and_score(own, "dt", models.STUMP)
    plans.compare(own, "dt", models.STUMP)
    assert own.storageLevel.useMemory
    own.unpersist()
    plans.train_and_score(own, "dt", models.STUMP)
    assert not own.storageLevel.useMemory and plans.KEEP == "cache"


def test_training_partitions_follow_the_rows_given(spark, encoded, monkeypatch):
    seen = []
    fit = models.fit
    monkeypatch.setattr(models, "fit", lambda rows, *a, **k: seen.append(rows.rdd.getNumPartitions()) or fit(rows, *a, **k))
    for rows_per_partition in (400, 10**6):
        plans.train_and_score(encoded, "dt", models.STUMP, rows_per_partition=rows_per_partition)
    n = plans.train_test(encoded)[0].count()
    assert seen == [-(-n // 400), 1]
