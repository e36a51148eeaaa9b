"""Keeping a table for reuse."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from groveline.sources.scratch import shared_dir


@contextmanager
def materialised(df: DataFrame, how: str = "cache") -> Iterator[DataFrame]:
    """Keep ``df`` for the length of a ``with`` block.

    ``cache`` holds it in executor memory, spilling to disk; blocks lost with an
    executor are recomputed from the source. ``checkpoint`` writes it once to the
    shared checkpoint folder and forgets the lineage: for a table that is costly
    to recompute and read many times. ``none`` hands the table on as it is. A table that its
    owner has cached already is left so.
    """
    if how == "none" or how == "cache" and (df.storageLevel.useMemory or df.storageLevel.useDisk):
        yield df
        return
    if how == "checkpoint":
        shared_dir(df.sparkSession)
        yield df.checkpoint(eager=True)
        return
    if how != "cache":
        raise ValueError("how must be 'none', 'cache' or 'checkpoint'")
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
