"""Column summaries, class counts, correlations and histograms.

Wide tables make one aggregate with hundreds of functions too large for the JIT
compiler (measured ten times slower), so values are turned into (column, value)
rows first: ``unpivot`` is a loop inside the generated code and the partial
aggregate right behind it leaves one row per column and task to shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groveline.functions.batches import MOMENTS, pair_cells, pair_moments
from groveline.operators.columns import numeric_columns

# Text that cannot be a number is kept away from the parser, whose failures are slow.
_MAY_BE_NUMBER = r"(?i)^[\x00-\x20]*[-+]?(\.?\d|nan|inf)"

# Counts that a task of the joint histogram holds at most, 8 bytes each.
MOST_CELLS = 4_000_000

# Types whose every value a double holds exactly.
_FITS_DOUBLE = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# Expressions of many columns are written as text: one call into the JVM per column.
def _as_doubles(names: Sequence[str]) -> list[str]:
    return [f"CAST({_quoted(c)} AS DOUBLE) AS {_quoted(c)}" for c in names]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class. Partial aggregation means one row per class and task is shuffled."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _as_number(field: T.StructField) -> Column:
    col = _ref(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.when(col.rlike(_MAY_BE_NUMBER), col.try_cast("double"))
    return col.cast("double")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric or text column: count, mean, sample deviation, min and max.

    ``min`` and ``max`` hold numbers; ``min_text`` and ``max_text`` hold the exact value
    as text, for text columns too. A text column has a mean and deviation over those
    of its values that read as numbers, if any. Columns of other types are left out.
    """
    fields = [
        f
        for f in df.schema.fields
        if (columns is None or f.name in columns)
        and isinstance(f.dataType, (T.NumericType, T.StringType))
    ]
    if not fields:
        raise ValueError("no numeric or text column to describe")
    exact = [f for f in fields if not isinstance(f.dataType, _FITS_DOUBLE)]
    plain = {f.name: f.dataType for f in fields if f not in exact}
    names = [f.name for f in fields]

    numbers = (
        df.select([_as_number(f).alias(f.name) for f in fields])
        .unpivot([], [_ref(n) for n in names], "column", "value")
        .groupBy("column")
        .agg(
            F.count("value").alias("count"),
            F.avg("value").alias("mean"),
            F.stddev_samp("value").alias("stddev"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )
    # every column has a row, also in an empty table
    listed = F.explode(F.array(*[F.lit(n) for n in names])).alias("column")
    per_column = df.sparkSession.range(0, 1, 1, 1).select(
        listed,
        F.lit(0).cast("bigint").alias("count"),
        *[F.lit(None).cast("double").alias(c) for c in ("mean", "stddev", "min", "max")],
    )
    text = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    is_text = F.col("column").isin(text)
    # one branch per type, not per column
    by_type: dict = {}
    for name, kind in plain.items():
        by_type.setdefault(kind, []).append(name)
    shown = F.lit(None).cast("string")
    shown_max = shown
    for kind, members in by_type.items():
        here = F.col("column").isin(members)
        shown = F.when(here, F.col("min").cast(kind).cast("string")).otherwise(shown)
        shown_max = F.when(here, F.col("max").cast(kind).cast("string")).otherwise(shown_max)
    parts = numbers.unionByName(per_column).select(
        "column",
        F.when(~is_text, F.col("count")).alias("count"),
        "mean",
        "stddev",
        F.when(~is_text, F.col("min")).alias("min"),
        F.when(~is_text, F.col("max")).alias("max"),
        shown.alias("min_text"),
        shown_max.alias("max_text"),
    )
    if exact:
        aggregates, entries = [], []
        for i, f in enumerate(exact):
            col = _ref(f.name)
            aggregates += [
                F.count(col).alias(f"n{i}"),
                F.min(col).cast("string").alias(f"lo{i}"),
                F.max(col).cast("string").alias(f"hi{i}"),
            ]
            entries.append(
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.col(f"n{i}").alias("count"),
                    F.col(f"lo{i}").alias("min_text"),
                    F.col(f"hi{i}").alias("max_text"),
                )
            )
        exact_part = df.agg(*aggregates).select(F.inline(F.array(*entries)))
        parts = parts.unionByName(exact_part, allowMissingColumns=True)
    return parts.groupBy("column").agg(
        *[F.max(c).alias(c) for c in ("count", "mean", "stddev", "min", "max", "min_text", "max_text")]
    )


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else numeric_columns(df)


def column_limits(df: DataFrame, names: Sequence[str]) -> dict[str, tuple]:
    """(mean, least, greatest, n_other) of each column; one aggregate, one row per column.

    The first three are over finite values and null without any; ``n_other`` counts NaN
    and infinite ones. A column without values has no entry. The values go into later
    plans as literals, which cost nothing per row.
    """
    if not names:
        return {}
    value = F.when(_is_finite(F.col("value")), F.col("value"))
    stats = (
        df.selectExpr(*_as_doubles(names))
        .unpivot([], [_quoted(c) for c in names], "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(F.avg(value), F.min(value), F.max(value), F.count_if(~_is_finite(F.col("value"))))
    )
    found = {column: tuple(limits) for column, *limits in stats.collect()}
    return {c: found[c] for c in names if c in found}


def _is_finite(value: Column) -> Column:
    # NaN counts as greater than infinity
    return F.abs(value) < F.lit(float("inf"))


def corr_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, over the whole table.

    Each task adds up the second moments of its rows, as matrix products on Arrow
    batches, and hands on one row per pair of columns. Values are taken relative to
    the column mean, which keeps the sums accurate. Rows with a null in either column
    do not count for that pair; a constant column has no correlation and gives null. A
    column with a NaN or an infinity gives NaN, as it has no mean. A table without rows
    gives no pairs.

    A task holds six numbers for each pair of columns: 12 MB for 500 of them.
    """
    names = _numeric(df, columns)
    limits = column_limits(df, names)
    centred = df.selectExpr(
        *[
            f"CAST({_quoted(c)} AS DOUBLE) - ({(limits[c][0] or 0.0) if c in limits else 0.0!r}D) AS c{i}"
            for i, c in enumerate(names)
        ]
    )
    sums = (
        centred.mapInArrow(pair_moments, "a int, b int, " + ", ".join(f"{m} double" for m in MOMENTS))
        .groupBy("a", "b")
        .agg(*[F.sum(m).alias(m) for m in MOMENTS])
    )
    n = F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    vxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    listed = F.array(*[F.lit(c) for c in names])
    odd = [i for i, c in enumerate(names) if c in limits and limits[c][3] > 0]
    varies = [
        i for i, c in enumerate(names) if c in limits and i not in odd and limits[c][1] < limits[c][2]
    ]
    has_odd = F.col("a").isin(odd) | F.col("b").isin(odd)
    defined = F.col("a").isin(varies) & F.col("b").isin(varies) & (n > 0) & (vx > 0) & (vy > 0)
    return sums.select(
        listed[F.col("a")].alias("left"),
        listed[F.col("b")].alias("right"),
        F.when(has_odd, F.lit(float("nan"))).when(defined, vxy / F.sqrt(vx * vy)).alias("corr"),
    )


def _edges(limits: tuple) -> tuple[float, float]:
    """Binning range; a constant column gets a range of width one around its value."""
    lo, hi = limits[1:3]
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def _binned(df: DataFrame, limits: dict[str, tuple], bins: int, other: int | None) -> DataFrame:
    """Every value replaced by the number of its equal-width bin; null has none.

    NaN and infinite values have the bin ``other``.
    """
    rest = "NULL" if other is None else str(other)
    shown = []
    for c, found in limits.items():
        value, place = f"CAST({_quoted(c)} AS DOUBLE)", "NULL"
        if found[1] is not None:
            lo, hi = _edges(found)
            # the greatest value belongs to the last bin
            place = f"least(floor(({value} - ({lo!r}D)) / {hi - lo!r}D * {bins}), {bins - 1})"
        shown.append(
            f"CAST(CASE WHEN abs({value}) < double('Infinity') THEN {place}"
            f" WHEN {value} IS NOT NULL THEN {rest} END AS INT) AS {_quoted(c)}"
        )
    return df.selectExpr(*shown)


def hist_1d(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Equal-width histogram of each numeric column; empty bins have no row.

    The range is that of the finite values. NaN and infinite ones are counted in a row of
    their own, without bin and edges. A table without values gives no row.
    """
    names = _numeric(df, columns)
    limits = column_limits(df, names)
    if not limits:
        return df.sparkSession.createDataFrame(
            [], "column string, bin int, lower double, upper double, n bigint"
        )
    counts = (
        _binned(df, limits, bins, -1)
        .unpivot([], [_quoted(c) for c in limits], "column", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranges = {c: _edges(found) for c, found in limits.items() if found[1] is not None}
    # one constant map; NaN and infinite values need none of it
    of_column = json.dumps({c: [lo, (hi - lo) / bins] for c, (lo, hi) in ranges.items()})
    edges = F.from_json(F.lit(of_column), "map<string, array<double>>")[F.col("column")]
    placed = counts.withColumns(
        {"edges": edges, "bin": F.when(F.col("bin") >= 0, F.col("bin"))}
    )
    start, step = F.get("edges", F.lit(0)), F.get("edges", F.lit(1))
    return placed.select(
        "column",
        "bin",
        (start + step * F.col("bin")).alias("lower"),
        (start + step * (F.col("bin") + 1)).alias("upper"),
        "n",
    )


def _tiles(n_columns: int, most: int) -> list[list[tuple[int, int, int]]]:
    """All pairs of columns as runs (left, first, stop), dealt into tiles of at most ``most`` pairs."""
    tiles: list[list[tuple[int, int, int]]] = [[]]
    room = most
    for left in range(n_columns - 1):
        first = left + 1
        while first < n_columns:
            if room == 0:
                tiles.append([])
                room = most
            stop = min(n_columns, first + room)
            tiles[-1].append((left, first, stop))
            room -= stop - first
            first = stop
    return tiles


def hist_2d(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int = 10,
    *,
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """Binned joint counts of every pair of numeric columns; empty cells have no row.

    This is what a scatter matrix shows, over the whole table and of bounded size: each
    task counts its rows into one array per pair and hands on the non-empty cells. The
    pairs are dealt into tiles of about ``most_cells`` counts, and each tile is a pass of
    its own over the columns it has, so a task never holds more than one tile, however
    many columns there are. Rows with a null, a NaN or an infinity in
    either column do not count for that pair.
    """
    limits = column_limits(df, _numeric(df, columns))
    names = list(limits)
    if len(names) < 2:
        return df.sparkSession.createDataFrame(
            [], "left string, right string, left_bin int, right_bin int, n bigint"
        )
    binned = _binned(df, limits, bins, None)
    counted = None
    for runs in _tiles(len(names), max(1, most_cells // (bins + 1) ** 2)):
        used = sorted({c for left, first, stop in runs for c in (left, *range(first, stop))})
        place = {c: i for i, c in enumerate(used)}
        local = [(place[left], place[first], place[first] + stop - first) for left, first, stop in runs]
        part = binned.select([_ref(names[c]) for c in used]).mapInArrow(
            pair_cells(local, used, bins), "left int, right int, left_bin int, right_bin int, n bigint"
        )
        counted = part if counted is None else counted.unionAll(part)
    by = ["left", "right", "left_bin", "right_bin"]
    listed = F.array(*[F.lit(c) for c in names])
    return (
        counted.groupBy(*by)
        .agg(F.sum("n").alias("n"))
        .withColumns({side: listed[F.col(side)] for side in ("left", "right")})
    )
