import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from groveline import presets as P
from groveline.operators import models, rules
from groveline.plans import campaign as plans

ENSEMBLES = [
    ("dt", models.SHALLOW["dt"], "none", P.NOMINAL),
    ("dt", models.DEFAULT["dt"], "before_split", None),
    ("dt", {"maxDepth": 12}, "none", P.NOMINAL),
    ("rf", models.SHALLOW["rf"], "none", None),
    ("rf", models.SHALLOW["rf"], "before_split", P.NOMINAL),
    ("rf", models.DEFAULT["rf"], "before_split", None),
    ("gbt", models.SHALLOW["gbt"], "none", None),
    ("gbt", models.DEFAULT["gbt"], "before_split", None),
]


@pytest.mark.parametrize("kind,params,balance,nominal", ENSEMBLES)
def test_votes_of_the_nodes_equal_the_model(spark, encoded, kind, params, balance, nominal):
    model, scored = plans.train_and_score(encoded, kind, params, balance=balance, nominal=nominal)
    _, test = plans.train_test(encoded, balance)
    found = {r[P.KEY]: r for r in rules.replay(spark, model, test, P.FEATURES).collect()}
    given = scored.select(P.KEY, "prediction", vector_to_array("rawPrediction").alias("raw")).collect()
    assert len(given) == len(found) == test.count()
    n_trees = len(getattr(models.tree_model(model), "trees", [model]))
    for r in given:
        own = found[r[P.KEY]]
        assert own["prediction"] == r["prediction"] and len(own["votes"]) == n_trees
        if kind == "dt":  # the model gives row counts
            assert own["raw"] == pytest.approx([x / sum(r["raw"]) for x in r["raw"]], abs=1e-12)
        else:
            assert own["raw"] == pytest.approx(r["raw"], abs=1e-9)


def test_nodes_form_binary_trees(spark, encoded):
    model, _ = plans.train_and_score(encoded, "rf", models.DEFAULT["rf"])
    nodes = rules.tree_nodes(spark, model).collect()
    by_tree = {}
    for n in nodes:
        by_tree.setdefault(n["tree"], {})[n["node"]] = n
    fitted = models.tree_model(model)
    assert [len(by_tree[t]) for t in sorted(by_tree)] == [t.numNodes for t in fitted.trees]
    for tree in by_tree.values():
        children = [c for n in tree.values() if n["feature"] is not None for c in (n["left"], n["right"])]
        assert sorted(children) == sorted(set(tree) - {0})
        for n in tree.values():
            if n["feature"] is not None:
                assert n["threshold"] is not None and n["categories"] is None
                assert n["n_rows"] == tree[n["left"]]["n_rows"] + tree[n["right"]]["n_rows"]


def test_nominal_splits_and_single_leaf(spark, encoded):
    rows = encoded.select(P.KEY, *P.FEATURES, F.col("housing").alias(P.LABEL))
    model, _ = plans.train_and_score(rows, "dt", {"maxDepth": 1}, nominal=P.NOMINAL)
    root = rules.tree_nodes(spark, model).where("node = 0").first()
    assert root["threshold"] is None and root["categories"] in ([0.0], [1.0])
    assert rules.replay(spark, model, rows, P.FEATURES).where(F.col("prediction") != F.col(P.LABEL)).count() == 0
    one = encoded.withColumn(P.LABEL, F.lit(0.0))
    leaf, _ = plans.train_and_score(one, "dt", {"maxDepth": 1})
    assert rules.tree_nodes(spark, leaf).count() == 1
    assert {r["prediction"] for r in rules.replay(spark, leaf, one, P.FEATURES).collect()} == {0.0}


def test_replay_runs_no_python_and_no_model(spark, encoded):
    model, _ = plans.train_and_score(encoded, "rf", models.SHALLOW["rf"])
    plan = rules.replay(spark, model, encoded, P.FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "UDF" not in plan
