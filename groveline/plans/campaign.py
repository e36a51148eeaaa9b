"""The campaign flows: prepare, train, compare, tune."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline import presets as P
from groveline.operators import evaluate, features, models, sampling, tuning
from groveline.operators.persist import materialised
from groveline.sources.scratch import shared_dir

# What the plans do with the encoded table unless told otherwise: it is read for class
# counts, layout and fit, and by default kept in the executors' memory and disks meanwhile.
KEEP = "cache"


def balanced(encoded: DataFrame, label: str = P.LABEL, key: str = P.KEY) -> DataFrame:
    """Every class brought down to the size of the smallest, by row hash."""
    fractions = sampling.balance_fractions(encoded, label)
    return sampling.stratified_sample(encoded, label, fractions, key=key)


def train_test(
    encoded: DataFrame, balance: str = "none", *, label: str = P.LABEL, key: str = P.KEY
) -> tuple[DataFrame, DataFrame]:
    """80/20 split by row hash.

    ``balance`` is ``"none"``, ``"before_split"`` (the test rows are balanced too) or
    ``"train_only"`` (the test rows keep the natural class shares).
    """
    if balance == "before_split":
        encoded = balanced(encoded, label, key)
    train, test = sampling.random_split(encoded, (0.8, 0.2), key=key)
    if balance == "train_only":
        train = balanced(train, label, key)
    elif balance not in ("none", "before_split"):
        raise ValueError("balance must be 'none', 'before_split' or 'train_only'")
    return train, test


def training_rows(
    train: DataFrame,
    *,
    nominal: Mapping[str, list[str]] | None = None,
    layout: int | None = None,
    keep: tuple[str, ...] = (),
    rows_per_partition: int = sampling.ROWS_PER_PARTITION,
) -> DataFrame:
    """Only what training reads, in a repeatable layout.

    ``layout`` is the number of partitions; by default there is one for every
    ``rows_per_partition`` rows.
    """
    narrow = train.select(P.KEY, *P.FEATURES, P.LABEL, *keep)
    narrow = sampling.stable_layout(narrow, layout, rows_per_partition=rows_per_partition)
    return features.declare_nominal(narrow, nominal) if nominal else narrow


def train_and_score(
    encoded: DataFrame,
    kind: str,
    params: Mapping,
    *,
    balance: str = "none",
    nominal: Mapping[str, list[str]] | None = None,
    seed: int = models.SEED,
    keep: str = KEEP,
    rows_per_partition: int = sampling.ROWS_PER_PARTITION,
):
    """Split, fit on the larger part, score the smaller. Gives (model, scored test rows).

    With ``keep`` the encoded table is kept while the model is fitted, so that class
    counts, layout and fit read the source once: ``cache`` lets go of it afterwards and
    the scored rows come from the source again, ``checkpoint`` serves those too, ``none``
    reads the source each time. ``rows_per_partition`` sizes the training partitions;
    raise it for tables of many millions.
    """
    with materialised(encoded, keep) as table:
        train, test = train_test(table, balance)
        rows = training_rows(train, nominal=nominal, rows_per_partition=rows_per_partition)
        model = models.fit(rows, kind, P.LABEL, P.FEATURES, seed=seed, params=params)
    return model, models.score(model, test)


def compare(
    encoded: DataFrame,
    kind: str,
    params: Mapping,
    *,
    balances: tuple[str, ...] = ("none", "before_split"),
    nominal: Mapping[str, list[str]] | None = None,
    keep: str = KEEP,
    rows_per_partition: int = sampling.ROWS_PER_PARTITION,
) -> DataFrame:
    """The metric report of one model trained on unbalanced and on balanced rows.

    The scored tables are counted together, in one aggregate. ``keep`` and
    ``rows_per_partition`` as for ``train_and_score``; the table kept serves all fits.
    """
    names = {"none": "unbalanced", "before_split": "balanced", "train_only": "balanced_train"}
    counts = None
    with materialised(encoded, keep) as table:
        for balance in balances:
            _, scored = train_and_score(
                table, kind, params, balance=balance, nominal=nominal, keep="none",
                rows_per_partition=rows_per_partition,
            )
            part = scored.select(
                F.lit(names[balance]).alias("dataset"), F.lit(kind).alias("model"), P.LABEL, "prediction"
            )
            counts = part if counts is None else counts.unionByName(part)
    by = ["dataset", "model"]
    return evaluate.metric_report(evaluate.confusion_counts(counts, P.LABEL, by=by), by)


def search(
    encoded: DataFrame,
    kind: str,
    params: Mapping,
    *,
    balance: str = "before_split",
    depths: list[int] = tuning.DEPTHS,
    parallelism: int = 4,
    keep: str = KEEP,
    rows_per_partition: int | None = None,
):
    """Split, search the depth on the training part. Gives (search, scored test rows).

    ``keep`` and ``rows_per_partition`` as for ``train_and_score``, but by default partitions
    are ``sampling.deep_partitions``. Memory for a training step is ``maxMemoryInMB`` among ``params``.
    """
    with materialised(encoded, keep) as table:
        train, test = train_test(table, balance)
        folded = sampling.with_fold(train, tuning.FOLDS, key=P.KEY)
        count = folded.count()
        layout = (
            sampling.deep_partitions(count)
            if rows_per_partition is None
            else sampling.layout_partitions(count, rows_per_partition)
        )
        rows = training_rows(folded, keep=("fold",), layout=layout)
        if kind == "dt":
            found = tuning.depth_path(rows, P.LABEL, P.FEATURES, depths=depths, **params)
        elif (
            kind == "rf"
            and tuning.forest_has_path(P.FEATURES, depths, **params)
            and shared_dir(table.sparkSession, required=False)  # where the nodes are written
        ):
            found = tuning.forest_path(rows, P.LABEL, P.FEATURES, depths=depths, **params)
        elif (
            kind == "gbt"
            and tuning.boosting_has_path(rows, P.FEATURES, depths, **params)
            and shared_dir(table.sparkSession, required=False)  # by which the model is made
        ):
            found = tuning.boosted_path(rows, P.LABEL, P.FEATURES, depths=depths, **params)
        else:
            found = tuning.cross_validate(
                rows, kind, P.LABEL, P.FEATURES, depths=depths, parallelism=parallelism, **params
            )
    return found, models.score(found.best_model, test)
