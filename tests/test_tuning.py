import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from groveline import presets as P
from groveline.operators import boosting, features, models, rules, sampling, tuning
from groveline.plans import campaign as plans


@pytest.fixture(scope="module")
def folded(encoded):
    train, _ = plans.train_test(encoded, "before_split")
    folded = sampling.with_fold(train, 3, key=P.KEY)
    return plans.training_rows(folded, layout=4, keep=("fold",)).cache()


def test_depth_path_equals_cross_validation(folded):
    depths = [2, 3, 5, 8, 12]
    full = tuning.cross_validate(folded, "dt", P.LABEL, P.FEATURES, depths=depths)
    fast = tuning.depth_path(folded, P.LABEL, P.FEATURES, depths=depths)
    assert fast.average == pytest.approx(full.average, abs=1e-12)
    assert fast.best_depth == full.best_depth
    assert max(fast.average) == fast.average[depths.index(fast.best_depth)]
    assert (
        models.tree_model(fast.best_model).toDebugString.splitlines()[1:]
        == models.tree_model(full.best_model).toDebugString.splitlines()[1:]
    )


@pytest.mark.parametrize("kind,params", [("rf", {"numTrees": 3}), ("gbt", {"maxIter": 2})])
def test_cross_validation_picks_the_best_depth_and_repeats(folded, kind, params):
    depths = [2, 4]
    one = tuning.cross_validate(folded, kind, P.LABEL, P.FEATURES, depths=depths, **params)
    two = tuning.cross_validate(folded, kind, P.LABEL, P.FEATURES, depths=depths, **params)
    assert one.average == two.average
    assert max(one.average) == one.average[depths.index(one.best_depth)]
    table = one.table(folded).collect()
    assert [r.max_depth for r in table] == depths
    assert sum(r.chosen for r in table) == 1


@pytest.mark.parametrize("kind,params", [("rf", {"numTrees": 3}), ("gbt", {"maxIter": 2})])
def test_search_equals_fits_fold_by_fold(folded, kind, params):
    """Without the cross-validator: every depth is fitted on the other folds, and its area
    comes from the confusion counts of the fold held out."""
    depths = [2, 3]
    found = tuning.cross_validate(folded, kind, P.LABEL, P.FEATURES, depths=depths, **params)
    for depth, average in zip(depths, found.average):
        areas = []
        for fold in range(tuning.FOLDS):
            model = models.fit(
                folded.where(F.col("fold") != fold), kind, P.LABEL, P.FEATURES,
                params={**params, "maxDepth": depth},
            )
            cells = {
                (r[P.LABEL], r["prediction"]): r["n"]
                for r in models.score(model, folded.where(F.col("fold") == fold))
                .groupBy(P.LABEL, "prediction")
                .agg(F.count("*").alias("n"))
                .collect()
            }
            shares = [
                cells.get((y, y), 0) / (cells.get((y, 0.0), 0) + cells.get((y, 1.0), 0)) for y in (0.0, 1.0)
            ]
            areas.append(sum(shares) / 2)
        assert average == pytest.approx(sum(areas) / len(areas), abs=1e-12)


def test_depth_path_refuses_what_it_does_not_honour(folded):
    for extra in ({"thresholds": [0.3, 0.7]}, {"depths": [2, 15]}):
        with pytest.raises(ValueError, match="depth path"):
            tuning.depth_path(folded, P.LABEL, P.FEATURES, **extra)


def test_forest_path_equals_cross_validation_with_one_fit_per_fold(folded, monkeypatch):
    depths, params = [2, 3, 5, 8, 12], {"numTrees": 10}
    full = tuning.cross_validate(folded, "rf", P.LABEL, P.FEATURES, depths=depths, **params)
    fits = []
    classifier = tuning.classifier
    monkeypatch.setattr(tuning, "classifier", lambda *a, **k: fits.append(k["maxDepth"]) or classifier(*a, **k))
    fast = tuning.forest_path(folded, P.LABEL, P.FEATURES, depths=depths, **params)
    assert fits == [12] * tuning.FOLDS
    assert fast.average == pytest.approx(full.average, abs=1e-12)
    assert fast.best_depth == full.best_depth
    assert (
        models.tree_model(fast.best_model).toDebugString.splitlines()[1:]
        == models.tree_model(full.best_model).toDebugString.splitlines()[1:]
    )


def test_search_of_a_forest_takes_the_path(encoded, monkeypatch):
    monkeypatch.setattr(tuning, "cross_validate", None)
    found, _ = plans.search(encoded, "rf", {"numTrees": 2}, depths=[1, 2])
    assert found.depths == [1, 2]


def test_forest_path_refuses_what_it_does_not_honour(folded):
    for extra in ({"thresholds": [0.3, 0.7]}, {"depths": [2, 15]}, {"maxMemoryInMB": 1}):
        with pytest.raises(ValueError, match="depth path"):
            tuning.forest_path(folded, P.LABEL, P.FEATURES, **extra)


def test_cut_off_trees_merge_sisters_that_say_the_same():
    def node(left, right, prediction, *stats):
        return Row(left=left, right=right, prediction=prediction, stats=list(stats))

    tree = [
        node(1, 4, 0.0, 8.0, 6.0),
        node(2, 3, 0.0, 7.0, 1.0), node(None, None, 0.0, 7.0, 0.0), node(None, None, 1.0, 0.0, 1.0),
        node(5, 6, 1.0, 1.0, 5.0), node(None, None, 1.0, 1.0, 2.0), node(None, None, 1.0, 0.0, 3.0),
    ]
    shares = tuning._cut_shares(tree, [0, 1, 2])
    assert shares[:, 0].tolist() == [[8 / 14, 6 / 14]] * 4
    assert shares[:, 1].tolist() == [[7 / 8, 1 / 8]] * 2 + [[1 / 6, 5 / 6]] * 2
    assert shares[:, 2].tolist() == [[1.0, 0.0], [0.0, 1.0], [1 / 6, 5 / 6], [1 / 6, 5 / 6]]


def test_boosting_cuts_its_lineage_after_every_tree(folded, monkeypatch):
    asked = []
    tree_pipeline = tuning.tree_pipeline
    monkeypatch.setattr(
        tuning, "tree_pipeline", lambda *a, **k: asked.append(k.get("checkpointInterval")) or tree_pipeline(*a, **k)
    )
    tuning.cross_validate(folded, "gbt", P.LABEL, P.FEATURES, depths=[1], maxIter=1)
    tuning.cross_validate(folded, "gbt", P.LABEL, P.FEATURES, depths=[1], maxIter=1, checkpointInterval=7)
    assert asked == [1, 7]


def test_deepest_fits_start_first(folded, monkeypatch):
    started = []
    side_by_side = tuning._side_by_side
    monkeypatch.setattr(
        tuning, "_side_by_side", lambda s, w, a, n: started.extend(a) or side_by_side(s, w, a, n)
    )
    found = tuning.cross_validate(folded, "gbt", P.LABEL, P.FEATURES, depths=[1, 2], maxIter=1)
    assert started == [(2, 0), (2, 1), (2, 2), (1, 0), (1, 1), (1, 2)]
    assert found.depths == [1, 2]


def test_grid_covers_the_fixed_depths():
    tree = models.classifier("dt", P.LABEL)
    assert [g[tree.maxDepth] for g in tuning.grid(tree)] == list(range(2, 13))


def test_leaf_paths_number_nodes_in_rule_order():
    rules = "\n".join(
        [
            "Model",
            "  If (feature 0 <= 1.0)",
            "   If (feature 1 <= 2.0)",
            "    Predict: 0.0",
            "   Else (feature 1 > 2.0)",
            "    Predict: 1.0",
            "  Else (feature 0 > 1.0)",
            "   Predict: 1.0",
        ]
    )
    assert tuning._leaf_paths(rules) == [[0, 1, 2], [0, 1, 3], [0, 4]]
    assert tuning._leaf_paths("Model\n  Predict: 0.0") == [[0]]


def test_boosted_path_equals_cross_validation(folded, monkeypatch):
    depths, params = [1, 3, 7], {"maxIter": 4}
    full = tuning.cross_validate(folded, "gbt", P.LABEL, P.FEATURES, depths=depths, **params)
    monkeypatch.setattr(models.Pipeline, "fit", None)
    fast = tuning.boosted_path(folded, P.LABEL, P.FEATURES, depths=depths, **params)
    assert fast.average == pytest.approx(full.average, abs=1e-12)
    assert fast.best_depth == full.best_depth


def test_boosted_path_gives_the_same_model(folded):
    """On one partition sums are added up in one order, so the nodes are equal to the last bit."""
    rows, params = folded.coalesce(1), {"maxIter": 3}
    full = models.fit(rows, "gbt", P.LABEL, P.FEATURES, params={**params, "maxDepth": 6})
    fast = tuning.boosted_path(rows, P.LABEL, P.FEATURES, depths=[6], **params).best_model
    mine, theirs = (rules.tree_nodes(rows.sparkSession, m).orderBy("tree", "node").collect() for m in (fast, full))
    assert mine == theirs
    scored = [models.score(m, rows).select("rawPrediction", "probability", "prediction").collect() for m in (fast, full)]
    assert scored[0] == scored[1]
    kept = ("maxDepth", "maxIter", "labelCol", "seed")
    assert [models.tree_model(fast).getOrDefault(p) for p in kept] == [models.tree_model(full).getOrDefault(p) for p in kept]


def test_boosted_path_splits_large_nodes_in_passes_over_all_blocks(folded, monkeypatch):
    params = {"depths": [2, 5], "maxIter": 3, "checkpointInterval": 1}
    local = tuning.boosted_path(folded, P.LABEL, P.FEATURES, **params)
    passes = []
    pass_over_large = boosting._pass_over_large
    monkeypatch.setattr(boosting, "_pass_over_large", lambda *a: passes.append(a[3]) or pass_over_large(*a))
    monkeypatch.setattr(boosting, "SMALL", 100)
    spread = tuning.boosted_path(folded, P.LABEL, P.FEATURES, **params)
    assert {0, 1, 2} <= set(passes)
    assert spread.average == pytest.approx(local.average, abs=0.01)  # equal gains are told apart by rounding
    assert spread.best_depth == local.best_depth


def test_search_of_boosted_trees_takes_the_path(encoded, monkeypatch):
    monkeypatch.setattr(tuning, "cross_validate", None)
    found, scored = plans.search(encoded, "gbt", {"maxIter": 2}, depths=[1, 2])
    assert found.depths == [1, 2]
    assert scored.count() > 0


def test_boosted_path_refuses_what_it_does_not_honour(folded):
    nominal = features.declare_nominal(folded, P.NOMINAL)
    for rows, extra in ((folded, {"subsamplingRate": 0.5}), (folded, {"depths": [2, 15]}), (nominal, {})):
        with pytest.raises(ValueError, match="boosted path"):
            tuning.boosted_path(rows, P.LABEL, P.FEATURES, **extra)


def test_features_summed_together_give_the_sums_of_each(monkeypatch):
    draw = np.random.default_rng(1)
    splits = np.array([6, 2, 11, 0, 4])
    bins = np.stack([draw.integers(0, n + 1, 4000) for n in splits]).astype("uint8")
    r, slot = draw.integers(-8, 9, 4000).astype("float64"), draw.integers(0, 3, 4000)
    each = boosting.level_sums(bins, r, slot, 3, splits, 12)
    monkeypatch.setattr(boosting, "_MANY", 1)
    assert len(boosting.joined(splits + 1, 83)) < len(splits)
    assert (boosting.level_sums(bins, r, slot, 3, splits, 12) == each).all()
    assert each[0].sum() == 4000 * len(splits)


def test_thresholds_are_between_values_or_at_equal_strides():
    assert boosting.thresholds(np.array([1.0, 0.0, 3.0, 3.0]), 4, 31).tolist() == [0.5, 2.0]
    assert boosting.thresholds(np.zeros(5), 5, 31).tolist() == []
    strides = boosting.thresholds(np.arange(1.0, 101.0), 100, 3)
    assert strides.tolist() == [25.5, 50.5, 75.5]
