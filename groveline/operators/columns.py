"""Projections: encoding, dropping, selecting, previewing, schema rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groveline import presets as P
from groveline.functions.codes import encode, nominal


def drop_column(df: DataFrame, *names: str) -> DataFrame:
    """Remove columns; the scan stops reading them."""
    return df.drop(*names)


def encode_columns(
    df: DataFrame,
    categories: Mapping[str, list[str]],
    *,
    strict: bool = True,
    label: str | None = None,
) -> DataFrame:
    """Replace category columns by their codes, in place and in one projection.

    ``label`` names the column, if encoded, whose category list is attached as
    metadata, so that a classifier knows the number of classes without a scan.
    """
    replaced = {}
    for name, values in categories.items():
        code = encode(name, P.codes(values), strict=strict)
        replaced[name] = nominal(code, name, values) if name == label else code
    return df.withColumns(replaced)


def encode_campaign(df: DataFrame, *, strict: bool = True) -> DataFrame:
    """Drop the unused column and encode the nine category columns."""
    return encode_columns(
        drop_column(df, P.UNUSED), P.CATEGORIES, strict=strict, label=P.LABEL
    )


def grouped(df: DataFrame, groups: Mapping[str, tuple[int, int]], most: int) -> DataFrame:
    """Replace numbers by the number of their group of equal width, the last one open.

    With as many groups as a tree has bins, every boundary between values is a candidate.
    """
    return df.withColumns(
        {
            name: F.least(F.floor((F.col(name) - start) / width), F.lit(most - 1)).cast("int")
            for name, (start, width) in groups.items()
        }
    )


def numeric_columns(df: DataFrame, *, widen: bool = False) -> list[str]:
    """Names of the ``int`` and ``double`` columns; of all numeric ones if ``widen``."""
    kinds = (T.NumericType,) if widen else (T.IntegerType, T.DoubleType)
    return [field.name for field in df.schema.fields if isinstance(field.dataType, kinds)]


def select_numeric(df: DataFrame, *, widen: bool = False) -> DataFrame:
    """Keep the numeric columns only."""
    return df.select(numeric_columns(df, widen=widen))


def preview(df: DataFrame, n: int = 5, order_by: str | list[str] | None = None) -> DataFrame:
    """First ``n`` rows; with ``order_by`` they are the same rows on every run.

    Sort and limit together keep ``n`` rows per task, there is no full sort.
    """
    if order_by is not None:
        df = df.orderBy(order_by)
    return df.limit(n)


def to_local(df: DataFrame, max_rows: int = 10_000) -> pd.DataFrame:
    """Bring a small result to the driver; refuse, rather than cut, a large one."""
    local = df.limit(max_rows + 1).toPandas()
    if len(local) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows")
    return local


def schema_rows(df: DataFrame) -> list[tuple[int, str, str, bool]]:
    """The schema as (position, column, type, nullable)."""
    return [
        (position, f.name, f.dataType.simpleString(), f.nullable)
        for position, f in enumerate(df.schema.fields)
    ]


def schema_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The schema as rows, with how many values each column really has and lacks."""
    wanted = list(columns) if columns is not None else df.columns
    rows = [r for r in schema_rows(df) if r[1] in wanted]
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{r[1]}`")).alias(f"c{r[0]}") for r in rows]
    )
    entries = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.lit(nullable).alias("nullable"),
            F.col(f"c{position}").alias("n_values"),
            (F.col("n") - F.col(f"c{position}")).alias("n_nulls"),
        )
        for position, name, kind, nullable in rows
    ]
    return counted.select(F.inline(F.array(*entries)))
