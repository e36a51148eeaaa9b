"""CSV scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    *,
    header: bool = True,
    sep: str = ",",
    mode: str | None = None,
    sampling_ratio: float | None = None,
) -> DataFrame:
    """Read delimited text with a declared schema, or infer one.

    With a schema the file is read once, the header is checked against the
    declared names, and a malformed value fails the job (``mode="FAILFAST"``)
    instead of turning into a null. Without one Spark reads the input a second
    time to infer types; ``sampling_ratio`` bounds that extra read on large inputs,
    and malformed values become null unless ``mode`` says otherwise.
    """
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        reader = (
            reader.schema(schema)
            .option("enforceSchema", False)
            .option("mode", mode or "FAILFAST")
        )
    else:
        reader = reader.option("inferSchema", True).option("mode", mode or "PERMISSIVE")
        if sampling_ratio is not None:
            reader = reader.option("samplingRatio", sampling_ratio)
    return reader.csv(path)
