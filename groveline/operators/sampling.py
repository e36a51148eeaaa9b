"""Stratified and plain samples, splits and folds.

Each comes in two modes. With ``key`` the draw is a hash of that unique row key:
repeatable, independent of partitioning, a plain filter in the plan. With
``seed`` it is Spark's own sampler, repeatable only while the partitioning stays
the same.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.functions import hashing

_MAX_CLASSES = 1000
ROWS_PER_PARTITION = 25_000


def _one_mode(key: str | None, seed: int | None) -> None:
    if (key is None) == (seed is None):
        raise ValueError("give either key (hash mode) or seed (Spark mode)")


def balance_fractions(df: DataFrame, label: str, *, max_classes: int = _MAX_CLASSES) -> dict:
    """Fraction per class that brings every class down to the size of the smallest.

    One aggregate over the label column; the driver receives one row per class,
    and more classes than ``max_classes`` is an error.
    """
    counts = (
        df.where(F.col(label).isNotNull()).groupBy(label).count().limit(max_classes + 1).collect()
    )
    if len(counts) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes")
    smallest = min((n for _, n in counts), default=0)
    return {value: smallest / n for value, n in counts}


def _fraction_of(df: DataFrame, label: str, fractions: Mapping) -> Column:
    """Looked up in a constant map, whatever the number of classes; 0 for one not listed."""
    if not fractions:
        return F.lit(0.0)
    kind = df.schema[label].dataType
    pairs = [x for value, f in fractions.items() for x in (F.lit(value).cast(kind), F.lit(float(f)))]
    return F.coalesce(F.create_map(*pairs)[F.col(label)], F.lit(0.0))


def stratified_sample(
    df: DataFrame,
    label: str,
    fractions: Mapping,
    *,
    key: str | None = None,
    seed: int | None = None,
) -> DataFrame:
    """Keep each row with the probability given for its class."""
    _one_mode(key, seed)
    if seed is not None:
        return df.sampleBy(label, fractions=dict(fractions), seed=seed)
    return df.where(hashing.row_uniform(key, hashing.STRATIFY) < _fraction_of(df, label, fractions))


def random_split(
    df: DataFrame,
    weights: Sequence[float] = (0.8, 0.2),
    *,
    key: str | None = None,
    seed: int | None = None,
) -> list[DataFrame]:
    """Cut the table into disjoint parts whose sizes follow ``weights``."""
    _one_mode(key, seed)
    if seed is not None:
        return df.randomSplit(list(weights), seed=seed)
    total = sum(weights)
    # the last part takes everything from its lower edge, so no row is lost to rounding
    edges = [0.0, *[w / total for w in accumulate(weights)][:-1], None]
    u = hashing.row_uniform(key, hashing.SPLIT)
    parts = []
    for low, high in zip(edges, edges[1:]):
        inside = F.lit(True)
        if low:
            inside = inside & (u >= low)
        if high is not None:
            inside = inside & (u < high)
        parts.append(df.where(inside))
    return parts


def bernoulli_sample(
    df: DataFrame, fraction: float, *, key: str | None = None, seed: int | None = None
) -> DataFrame:
    """Keep each row with the same probability, without replacement."""
    _one_mode(key, seed)
    if seed is not None:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    return df.where(hashing.row_uniform(key, hashing.SAMPLE) < fraction)


def with_fold(df: DataFrame, k: int, *, key: str, name: str = "fold") -> DataFrame:
    """Add the number of the cross-validation fold, 0 .. k-1, as an int column."""
    return df.withColumn(name, (hashing.row_hash(key, hashing.FOLD) % k).cast("int"))


def layout_partitions(rows: int, rows_per_partition: int = ROWS_PER_PARTITION) -> int:
    """Partitions for training on so many rows: in proportion, whatever their number."""
    return max(1, math.ceil(rows / rows_per_partition))


def deep_partitions(rows: int) -> int:
    """Partitions for deep trees, where each task hands on counts for thousands of nodes.

    Those counts are as large for a small partition as for a large one, so the number grows with
    the square root of the rows, and is never above that of ``layout_partitions``.
    """
    return min(layout_partitions(rows), max(1, math.ceil(math.sqrt(rows) / 100)))


def stable_layout(
    df: DataFrame,
    partitions: int | None = None,
    *,
    rows_per_partition: int = ROWS_PER_PARTITION,
    spread_copies: bool = False,
) -> DataFrame:
    """Place and order rows by their whole content.

    Bagging draws per partition and row position, and split candidates may come from
    a row sample; after this one shuffle both are the same on every run and cluster,
    however the rows lay before. A column that is alike in many rows does not gather
    them, because all columns count. Without ``partitions`` the rows are counted.

    Rows that are equal in every column still meet. Where those may be many,
    ``spread_copies`` numbers the copies and places them by content and number: one more
    shuffle, of partial counts.
    """
    names = [f"`{c}`" for c in df.columns]
    if partitions is None:
        partitions = layout_partitions(df.count(), rows_per_partition)
    if not spread_copies:
        placed = df.repartition(partitions, F.xxhash64(*names))
        return placed.sortWithinPartitions(F.xxhash64(*names), *names)
    copies = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__copies"))
    each = copies.select(*names, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    placement = F.xxhash64(*names, "__copy")
    placed = each.repartition(partitions, placement).sortWithinPartitions(placement, *names)
    # metadata of columns is kept by naming them from the table given
    return placed.select([F.col(n).alias(c, metadata=df.schema[c].metadata) for n, c in zip(names, df.columns)])
