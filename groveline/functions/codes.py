"""Category text -> numeric code, as a lookup in a constant map."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(column: str | Column, mapping: Mapping[str, float], *, strict: bool = True) -> Column:
    """Numeric code of a category.

    The map is a literal, so Catalyst folds it to one constant and the lookup
    stays in generated code. ``strict`` fails the job on a value outside the map
    (nulls included); otherwise such a value gives null.
    """
    col = F.col(column) if isinstance(column, str) else column
    pairs = chain.from_iterable((F.lit(k), F.lit(float(v))) for k, v in mapping.items())
    code = F.create_map(*pairs)[col]
    if not strict:
        return code
    complaint = F.concat(F.lit("unmapped "), F.coalesce(col.cast("string"), F.lit("NULL")))
    return F.coalesce(code, F.raise_error(complaint).cast("double"))


def nominal(column: Column, name: str, values: list[str]) -> Column:
    """Attach the category list as ML attribute metadata, making the column nominal."""
    return column.alias(name, metadata={"ml_attr": {"type": "nominal", "vals": values, "name": name}})
