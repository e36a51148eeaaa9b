"""Column expressions and small table helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groveline.sources.scratch import fresh_path, remove

# A word, between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    An expression used inside a lambda is otherwise computed anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1; no element for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def running_totals(values: Column, block: int = 256) -> Column:
    """For each element of a bigint array the sum of the elements before it.

    Totals of whole blocks come first, so that appending copies short arrays only.
    """
    empty = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")

    def before(array: Column, start: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            return F.struct(
                (state["total"] + x).alias("total"),
                F.array_append(state["seen"], state["total"]).alias("seen"),
            )

        first = F.struct(start.alias("total"), empty.alias("seen"))
        return F.aggregate(array, first, step, lambda state: state["seen"])

    def of(array: Column) -> Column:
        blocks = F.transform(
            upto(F.ceil(F.size(array) / F.lit(block)).cast("int")),
            lambda i: F.slice(array, i * block + 1, F.lit(block)),
        )

        def join(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda s, x: s + x))
            return bind(
                before(totals, zero),
                lambda starts: F.flatten(
                    F.transform(parts, lambda p, i: before(p, F.get(starts, i)))
                ),
            )

        return bind(blocks, join)

    return bind(values, of)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Its rows are then fixed, survive the loss of executors, and have a known size by
    which Spark can decide about broadcasting.
    """
    spark: SparkSession = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.kept_path = path
    return table


def drop_table(table: DataFrame) -> None:
    """Delete the files of a kept table that no later result reads."""
    remove(table.sparkSession, table.kept_path)


# Keys with more than one row in so many are hot; there are fewer of them than that.
MOST_HOT = 1000


def left_join_hot(rows: DataFrame, table: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each string ``on``.

    ``weight`` is the number of rows a key has, and ``total`` no less than the sum of those
    met in ``table``. Hot keys are broadcast, and their rows then get keys of their own that
    match nothing, so they are spread over all tasks of the join with the other keys.
    """
    others = F.struct(*[c for c in table.columns if c not in (on, weight)])
    is_hot = F.col(weight) * MOST_HOT > total
    hot = table.where(is_hot).select(F.col(on).alias("__hot_key"), others.alias("__hot"))
    rest = table.where(~is_hot).select(F.col(on).alias("__rest_key"), others.alias("__rest"))
    marked = rows.join(F.broadcast(hot), rows[on] == F.col("__hot_key"), "left")
    apart = F.concat(F.lit(" "), F.xxhash64(*rows.columns).cast("string"))
    key = F.when(F.col("__hot").isNull(), F.col(on)).otherwise(apart)
    met = marked.withColumn("__key", key).join(rest, F.col("__key") == F.col("__rest_key"), "left")
    both = F.coalesce("__hot", "__rest")
    return met.select(*rows.columns, *[both[c].alias(c) for c in table.columns if c not in (on, weight)])
