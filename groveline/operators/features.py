"""Feature vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.functions.codes import nominal


def declare_nominal(df: DataFrame, columns: Mapping[str, list[str]]) -> DataFrame:
    """Mark coded columns as nominal: trees then split on sets of codes, not on order."""
    return df.withColumns({c: nominal(F.col(c), c, values) for c, values in columns.items()})


def assembler(features: Sequence[str], output: str = "features") -> VectorAssembler:
    """The pipeline stage; a null or NaN feature fails the job."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error")


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Add the feature vector, elements in the order of ``features``."""
    return assembler(features, output).transform(df)


def labelled_points(df: DataFrame, label: str, features: Sequence[str], *keep: str) -> DataFrame:
    """(label, features) rows, columns taken by name wherever they stand."""
    return assemble(df, features).select(*keep, F.col(label).cast("double").alias(label), "features")


def features_as_array(df: DataFrame, column: str = "features") -> DataFrame:
    """Replace the vector by a plain array, for SQL and for output."""
    return df.withColumn(column, vector_to_array(column))
