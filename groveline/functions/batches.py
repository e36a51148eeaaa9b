"""Sums over Arrow batches, run inside tasks.

Each function folds the batches of one task into one small batch of partial sums,
which Spark then groups and adds up.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Send the code itself to the workers, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Batches = Iterator[pa.RecordBatch]

MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where null) and validity of a batch, one matrix column per table column."""
    valid = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
    values = np.column_stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns])
    return values, valid


def pair_moments(batches: Batches) -> Batches:
    """Per pair of columns: n, sum x, sum y, sum x^2, sum y^2, sum xy where both are there and finite."""
    total = None
    for batch in batches:
        x, valid = _columns(batch)
        finite = np.isfinite(x)
        if not finite.all():
            x, valid = np.where(finite, x, 0.0), valid & finite
        v = valid.astype(np.float64)
        squares = x * x
        part = np.stack([v.T @ v, x.T @ v, v.T @ x, squares.T @ v, v.T @ squares, x.T @ x])
        total = part if total is None else total + part
    if total is None:
        return
    a, b = np.triu_indices(total.shape[1], k=1)
    sums = {"a": a.astype(np.int32), "b": b.astype(np.int32)}
    sums.update({name: t[a, b] for name, t in zip(MOMENTS, total)})
    yield pa.RecordBatch.from_pydict(sums)


def pair_cells(runs: list[tuple[int, int, int]], numbers: list[int], bins: int) -> Callable[[Batches], Batches]:
    """How many rows fall into each of bins x bins cells, for runs of pairs of bin-number columns.

    A run (left, first, stop) is the column ``left`` with every column from ``first`` up to
    ``stop``; its pairs are counted at once. ``numbers`` are the columns' names in the
    result. A task holds as many counts as the runs have cells.
    """
    width = bins + 1  # the last bin is that of missing values
    cells = width * width

    def count(batches: Batches, rows: int = 2048) -> Batches:
        totals = [np.zeros((stop - first) * cells, dtype=np.int64) for _, first, stop in runs]
        for batch in batches:
            values, valid = _columns(batch)
            bin_of = np.where(valid, values, bins).astype(np.int64)
            for begin in range(0, len(bin_of), rows):
                part = bin_of[begin : begin + rows]
                for total, (left, first, stop) in zip(totals, runs):
                    cell = part[:, first:stop] + part[:, left][:, None] * width
                    cell += np.arange(stop - first) * cells
                    total += np.bincount(cell.ravel(), minlength=len(total))
        for total, (left, first, stop) in zip(totals, runs):
            right, i, j = np.nonzero(total.reshape(-1, width, width)[:, :bins, :bins])
            yield pa.RecordBatch.from_pydict(
                {
                    "left": pa.array(np.full(len(right), numbers[left], dtype=np.int32)),
                    "right": pa.array(np.array(numbers, dtype=np.int32)[first + right]),
                    "left_bin": pa.array(i.astype(np.int32)),
                    "right_bin": pa.array(j.astype(np.int32)),
                    "n": pa.array(total.reshape(-1, width, width)[right, i, j]),
                }
            )

    return count
