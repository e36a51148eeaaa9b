"""Registered queries, their SQL twins, and the flagship query.

Each query is a callable (spark, sf_dir) -> DataFrame over the tables in ``sf_dir``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parent)
if _ROOT not in sys.path:
    sys.path.insert(0, _ROOT)

import oracles  # noqa: E402
from groveline import presets as P  # noqa: E402
from groveline.operators import (  # noqa: E402
    columns,
    evaluate,
    features,
    models,
    persist,
    profile,
    rules,
    sampling,
    tuning,
)
from groveline.plans import campaign as plans  # noqa: E402
from groveline.sources.campaign import campaign  # noqa: E402
from groveline.sources.csv import read_csv  # noqa: E402
from groveline.sources.scratch import fresh_path  # noqa: E402

try:  # the corpus operators can be absent as a whole; an error inside them is not hidden
    import corpus_pipeline  # noqa: E402
    from groveline.llm import queries as corpus_queries  # noqa: E402
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "groveline.llm"):
        raise
    corpus_pipeline = corpus_queries = None

Query = Callable[[SparkSession, str], DataFrame]

_ENCODED = [*P.FEATURES, P.LABEL]
_ENCODERS = {
    "binary": ["housing", "loan", "deposit"],
    "job": ["job"],
    "marital": ["marital"],
    "education": ["education"],
    "contact": ["contact"],
    "month": ["month"],
    "poutcome": ["poutcome"],
}


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    return columns.encode_campaign(campaign(spark, sf))


def _coarse(spark: SparkSession, sf: str) -> DataFrame:
    """At most 32 values in a column: 32 bins are then all thresholds, as SQL tries them."""
    return columns.grouped(_encoded(spark, sf), P.GROUPS, P.MOST_GROUPS)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    # adding 0.0 turns a negative zero into zero
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _spread(df: DataFrame, *keep: str) -> DataFrame:
    """The feature vector as columns f0, f1, ..."""
    vector = vector_to_array("features")
    return df.select(*keep, *[vector[i].alias(f"f{i}") for i in range(len(P.FEATURES))])


# --- sources -----------------------------------------------------------------


def _csv_copy(spark: SparkSession, sf: str) -> str:
    path = fresh_path(spark, "campaign-csv")
    campaign(spark, sf).write.option("header", True).csv(path)
    return path


def scan_csv(spark, sf):
    return read_csv(spark, _csv_copy(spark, sf), P.KEYED_CAMPAIGN_SCHEMA)


def scan_csv_inferred(spark, sf):
    inferred = read_csv(spark, _csv_copy(spark, sf))
    return inferred.withColumn(P.KEY, F.col(P.KEY).cast("bigint"))


# --- projections -------------------------------------------------------------


def _encoder(names: list[str]) -> Query:
    def query(spark, sf):
        one = columns.encode_columns(campaign(spark, sf), {n: P.CATEGORIES[n] for n in names})
        return one.select(P.KEY, *names)

    return query


def numeric_columns(spark, sf):
    return columns.select_numeric(spark.read.parquet(f"{sf}/lineitem.parquet"))


def materialised_encode(spark, sf):
    """The encoded table, written to the shared folder once and read from there."""
    with persist.materialised(_encoded(spark, sf), "checkpoint") as kept:
        return kept


def bounded_collect(spark, sf):
    """Rows per class, brought to the driver within a limit."""
    local = columns.to_local(profile.class_counts(campaign(spark, sf), P.LABEL), 100)
    return spark.createDataFrame(local, f"{P.LABEL} string, n bigint")


# --- profiles ----------------------------------------------------------------


def _described(df: DataFrame, names: list[str]) -> DataFrame:
    return _rounded(profile.describe(df, names), 6, "mean", "stddev")


def describe_train(spark, sf):
    return _described(plans.train_test(_encoded(spark, sf))[0], _ENCODED)


# --- samples -----------------------------------------------------------------


def _parts(df: DataFrame, *keep: str) -> DataFrame:
    train, test = sampling.random_split(df, (0.8, 0.2), key=P.KEY)
    return train.select(*keep, F.lit("train").alias("part")).unionByName(
        test.select(*keep, F.lit("test").alias("part"))
    )


def bernoulli_sample(spark, sf):
    train, _ = plans.train_test(_encoded(spark, sf))
    numeric = train.select(P.KEY, *columns.numeric_columns(train))
    return sampling.bernoulli_sample(numeric, 0.02, key=P.KEY)


def kfold_assign(spark, sf):
    train, _ = plans.train_test(_encoded(spark, sf), "before_split")
    return sampling.with_fold(train, tuning.FOLDS, key=P.KEY).select(P.KEY, "fold")


# --- features ----------------------------------------------------------------


def assemble_features(spark, sf):
    return _spread(features.assemble(_encoded(spark, sf), P.FEATURES), P.KEY, P.LABEL)


def assemble_nominal(spark, sf):
    """What the assembled vector declares about each element, with the element's sum."""
    marked = features.declare_nominal(_encoded(spark, sf), P.NOMINAL)
    assembled = features.assemble(marked, P.FEATURES)
    declared = assembled.schema["features"].metadata["ml_attr"]["attrs"]
    kinds = {a["idx"]: (kind, a) for kind, group in declared.items() for a in group}
    vector = vector_to_array("features")
    elements = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(attribute["name"]).alias("name"),
                F.lit(kind).alias("kind"),
                F.lit(len(attribute["vals"]) if kind == "nominal" else 0).alias("arity"),
            )
            for i, (kind, attribute) in sorted(kinds.items())
        ]
    )
    totals = assembled.select(F.posexplode(vector).alias("i", "value")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )
    return totals.select(elements[F.col("i")].alias("e"), "n", "total").select("e.*", "n", "total")


# --- scoring with one exact split --------------------------------------------


def _stump(spark: SparkSession, sf: str, balance: str = "none"):
    return plans.train_and_score(_coarse(spark, sf), "dt", models.STUMP, balance=balance)


def _stump_counts(spark: SparkSession, sf: str, balance: str = "none") -> DataFrame:
    return evaluate.confusion_counts(_stump(spark, sf, balance)[1], P.LABEL)


def score_select(spark, sf):
    return _spread(_stump(spark, sf)[1], P.KEY, "prediction", P.LABEL)


def predictions_labels(spark, sf):
    return evaluate.predictions_labels(_stump(spark, sf)[1], P.LABEL)


def tree_rules(spark, sf):
    return models.tree_rules(spark, _stump(spark, sf)[0])


def confusion_matrix(spark, sf, balance="none"):
    return evaluate.confusion_matrix(_stump_counts(spark, sf, balance), (0.0, 1.0))


def metric_report(spark, sf):
    return _rounded(plans.compare(_coarse(spark, sf), "dt", models.STUMP), 9, "value")


def auc_score(spark, sf):
    _, scored = _stump(spark, sf)
    by_duration = scored.withColumn("score", F.col("duration").cast("double"))
    areas = [
        ("tree", evaluate.auc_score(scored, P.LABEL)),
        ("duration", evaluate.auc_score(by_duration, P.LABEL, "score")),
    ]
    return _rounded(spark.createDataFrame(areas, "score string, auc double"), 6, "auc")


# --- models ------------------------------------------------------------------


# Models whose result SQL can repeat: no row or feature is drawn by chance. A forest draws
# both; without that its trees are all the same, which says little about forests, so their
# votes are replayed beside.
_EXACT = {
    "dt": models.SHALLOW["dt"],
    "rf": {**models.SHALLOW["rf"], "bootstrap": False, "featureSubsetStrategy": "all"},
    "gbt": models.SHALLOW["gbt"],
}


def _exact(kind: str, balance: str, params: dict | None = None) -> Query:
    """The confusion matrix of a model of which SQL repeats every split."""

    def query(spark, sf):
        _, scored = plans.train_and_score(
            _coarse(spark, sf), kind, _EXACT[kind] if params is None else params, balance=balance,
            nominal=P.NOMINAL if kind == "dt" and params is None else None,
        )
        return evaluate.confusion_matrix(evaluate.confusion_counts(scored, P.LABEL), (0.0, 1.0))

    return query


def _votes(kind: str, preset: dict, balance: str) -> Query:
    """What every tree of a fitted ensemble says about the test rows, and what follows."""

    def query(spark, sf):
        model, _ = plans.train_and_score(_encoded(spark, sf), kind, preset[kind], balance=balance)
        _, test = plans.train_test(_encoded(spark, sf), balance)
        replayed = rules.replay(spark, model, test, P.FEATURES)
        return replayed.select(P.KEY, P.LABEL, "votes", "raw", "prediction")

    return query


def score_gbt_exact(spark, sf):
    """The margins of the boosted trees, from their nodes."""
    coarse = _coarse(spark, sf)
    model, _ = plans.train_and_score(coarse, "gbt", models.DEFAULT["gbt"], balance="before_split")
    _, test = plans.train_test(coarse, "before_split")
    replayed = rules.replay(spark, model, test, P.FEATURES)
    margins = replayed.select(P.KEY, "prediction", P.LABEL, F.col("raw")[1].alias("margin"))
    return _rounded(margins, 6, "margin")


def _report(kind: str, preset: dict, balance: str, nominal=None) -> Query:
    """Fit a preset and report every measure on the test rows."""

    def query(spark, sf):
        _, scored = plans.train_and_score(
            _encoded(spark, sf), kind, preset[kind], balance=balance, nominal=nominal
        )
        return evaluate.metric_report(evaluate.confusion_counts(scored, P.LABEL))

    return query


# --- depth search ------------------------------------------------------------


def _search(spark: SparkSession, sf: str, kind: str, depths=tuning.DEPTHS):
    return plans.search(
        _encoded(spark, sf), kind, models.DEFAULT[kind], depths=depths, parallelism=8
    )


def cross_validation(kind: str, depths=tuning.DEPTHS) -> Query:
    def query(spark, sf):
        found, scored = _search(spark, sf, kind, depths)
        return found.table(scored)

    return query


def _exact_search(spark: SparkSession, sf: str):
    return plans.search(_coarse(spark, sf), "dt", {})


def cv_exact(spark, sf):
    found, scored = _exact_search(spark, sf)
    return _rounded(found.table(scored), 9, "avg_auc")


def best_model_exact(spark, sf):
    return models.model_summary(spark, _exact_search(spark, sf)[0].best_model)


def score_tuned_exact(spark, sf):
    return _exact_search(spark, sf)[1].select(P.KEY, "prediction", P.LABEL)


def auc_tuned_exact(spark, sf):
    scored = _exact_search(spark, sf)[1]
    return _rounded(evaluate.auc_hard(evaluate.confusion_counts(scored, P.LABEL)), 9, "auc")


def score_preview(spark, sf):
    """The rows to show are taken first, so only those are scored."""
    model, _ = _stump(spark, sf)
    _, test = plans.train_test(_coarse(spark, sf))
    return _spread(models.score(model, columns.preview(test, 25, P.KEY)), P.KEY, "prediction", P.LABEL)


def best_model_summary(spark, sf):
    return models.model_summary(spark, _search(spark, sf, "dt")[0].best_model)


def score_tuned(spark, sf):
    return _spread(_search(spark, sf, "dt")[1], P.KEY, "prediction", P.LABEL)


def auc_tuned(spark, sf):
    return evaluate.auc_hard(evaluate.confusion_counts(_search(spark, sf, "dt")[1], P.LABEL))


# -----------------------------------------------------------------------------


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Encode, split, train one exact split, score, count: the confusion matrix."""
    return confusion_matrix(spark, sf_dir)


def _corpus_queries() -> dict[str, Query]:
    if corpus_queries is None:
        return {}
    return {**corpus_queries.queries(), "pipeline": corpus_pipeline.run}


def _corpus_oracles() -> dict[str, str]:
    if corpus_queries is None:
        return {}
    sql = corpus_pipeline.ORACLE_SQL
    return {**corpus_queries.oracle_sql(), **({"pipeline": sql} if sql else {})}


def queries() -> dict[str, Query]:
    return {
        "scan_csv": scan_csv,
        "scan_csv_inferred": scan_csv_inferred,
        "schema_profile": lambda s, d: columns.schema_profile(campaign(s, d)),
        "drop_column": lambda s, d: columns.drop_column(campaign(s, d), P.UNUSED),
        "encode_all": _encoded,
        **{f"encode_{name}": _encoder(names) for name, names in _ENCODERS.items()},
        "materialised_encode": materialised_encode,
        "bounded_collect": bounded_collect,
        "numeric_columns": numeric_columns,
        "preview": lambda s, d: columns.preview(campaign(s, d), 5, P.KEY),
        "class_counts": lambda s, d: profile.class_counts(campaign(s, d), P.LABEL),
        "class_counts_balanced": lambda s, d: profile.class_counts(
            plans.balanced(_encoded(s, d)), P.LABEL
        ),
        "describe_raw": lambda s, d: _described(campaign(s, d), P.CAMPAIGN_COLUMNS),
        "describe_encoded": lambda s, d: _described(_encoded(s, d), _ENCODED),
        "describe_train": describe_train,
        "corr_pairs": lambda s, d: _rounded(
            profile.corr_pairs(_encoded(s, d), _ENCODED), 6, "corr"
        ),
        "hist_1d": lambda s, d: _rounded(
            profile.hist_1d(_encoded(s, d), _ENCODED), 6, "lower", "upper"
        ),
        "hist_2d": lambda s, d: profile.hist_2d(_encoded(s, d), _ENCODED),
        "stratified_sample": lambda s, d: plans.balanced(_encoded(s, d)).select(P.KEY, P.LABEL),
        "random_split": lambda s, d: _parts(_encoded(s, d), P.KEY),
        "split_balanced": lambda s, d: _parts(plans.balanced(_encoded(s, d)), P.KEY, P.LABEL),
        "bernoulli_sample": bernoulli_sample,
        "kfold_assign": kfold_assign,
        "assemble_features": assemble_features,
        "assemble_nominal": assemble_nominal,
        "score_select": score_select,
        "score_preview": score_preview,
        "predictions_labels": predictions_labels,
        "tree_rules": tree_rules,
        "confusion_matrix": confusion_matrix,
        "confusion_matrix_balanced": lambda s, d: confusion_matrix(s, d, "before_split"),
        "precision_by_label": lambda s, d: evaluate.precision_by_label(_stump_counts(s, d)),
        "recall_by_label": lambda s, d: evaluate.recall_by_label(_stump_counts(s, d)),
        "f_measures": lambda s, d: _rounded(evaluate.f_measures(_stump_counts(s, d)), 9, "value"),
        "metric_report": metric_report,
        "auc_hard": lambda s, d: _rounded(evaluate.auc_hard(_stump_counts(s, d)), 9, "auc"),
        "auc_score": auc_score,
        "dt_depth2": _report("dt", models.SHALLOW, "none", P.NOMINAL),
        "dt_depth2_balanced": _report("dt", models.SHALLOW, "before_split", P.NOMINAL),
        **{
            f"{kind}_{name}": _exact(kind, balance)
            for kind, names in (
                ("dt", ("depth2_exact", "depth2_balanced_exact")),
                ("rf", ("exact", "balanced_exact")),
                ("gbt", ("exact", "balanced_exact")),
            )
            for name, balance in zip(names, ("none", "before_split"))
        },
        "dt_default_exact": _exact("dt", "before_split", models.DEFAULT["dt"]),
        "gbt_10_exact": _exact("gbt", "before_split", models.DEFAULT["gbt"]),
        "score_gbt_exact": score_gbt_exact,
        "rf_depth2_votes": _votes("rf", models.SHALLOW, "none"),
        "rf_depth2_balanced_votes": _votes("rf", models.SHALLOW, "before_split"),
        "rf_10_votes": _votes("rf", models.DEFAULT, "before_split"),
        "rf_depth2": _report("rf", models.SHALLOW, "none"),
        "rf_depth2_balanced": _report("rf", models.SHALLOW, "before_split"),
        "gbt_iter3": _report("gbt", models.SHALLOW, "none"),
        "gbt_iter3_balanced": _report("gbt", models.SHALLOW, "before_split"),
        "dt_default": _report("dt", models.DEFAULT, "before_split"),
        "rf_10": _report("rf", models.DEFAULT, "before_split"),
        "gbt_10": _report("gbt", models.DEFAULT, "before_split"),
        "cv_dt": cross_validation("dt"),
        "cv_rf": cross_validation("rf"),
        "cv_gbt": cross_validation("gbt"),
        "cv_exact": cv_exact,
        "best_model_exact": best_model_exact,
        "score_tuned_exact": score_tuned_exact,
        "auc_tuned_exact": auc_tuned_exact,
        "best_model_summary": best_model_summary,
        "score_tuned": score_tuned,
        "auc_tuned": auc_tuned,
        **_corpus_queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {**oracles.oracle_sql(), **_corpus_oracles()}
