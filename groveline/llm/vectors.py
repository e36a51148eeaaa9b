"""What the operators on vectors share: valid rows and matrices inside tasks."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def usual_length(table: DataFrame, vector: Column) -> int:
    """The most common length of the vectors, the smaller of equally common ones; 0 if none."""
    lengths = table.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.where("d > 0").orderBy(F.desc("n"), "d").first()
    return found.d if found else 0


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Rows of numbers as a matrix of doubles."""
    if not len(column):
        return np.empty((0, dims))
    return np.vstack(column.to_list()).astype(np.float64)


def packed(values: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(values)]


def unpacked(column: pd.Series, dims: int, dtype=np.float64) -> np.ndarray:
    """The matrix that ``packed`` made rows of bytes of."""
    joined = b"".join(column.to_list())
    return np.frombuffer(joined, dtype=dtype).reshape(-1, dims)
