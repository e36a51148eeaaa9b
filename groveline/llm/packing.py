"""Best-fit packing of texts into training sequences, with conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm import kernels
from groveline.llm.columns import kept_table, words

CAPACITY = 2048
GROUP = 4096


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    group: int = GROUP,
) -> DataFrame:
    """(doc_id, piece, start_word, n_words, bin, offset): where each text goes.

    A bin holds ``capacity`` words, at most one text of a source and one of a duplicate
    cluster. ``cluster`` names a column; without it equal texts are a cluster. A text of
    more words is cut into pieces of ``capacity`` words and a last, shorter one; every
    word of every text is placed once.

    Rows are dealt into groups of about ``group`` by a hash, and each group is packed by
    itself, longest first, into the tightest bin that conflicts with nothing; so a task
    holds one bounded group, whatever the sizes of sources and clusters. Only lengths
    and hashes move, not texts.

    Null sources and null clusters never conflict; nor do empty texts of no cluster. A
    null or empty text is an item of length zero and takes no room. Repeated rows are
    items of their own. An empty table gives no row. Other columns are left out.
    """
    body = F.col(f"`{text}`")
    items = kept_table(
        docs.select(
            F.col(f"`{key}`").alias("doc_id"),
            F.size(words(body)).cast("bigint").alias("n_words"),
            F.xxhash64(F.col(f"`{source}`").cast("string")).alias("source_hash"),
            F.col(f"`{source}`").isNotNull().alias("has_source"),
            F.xxhash64(F.col(f"`{cluster}`").cast("string") if cluster else body).alias("cluster_hash"),
            (F.col(f"`{cluster}`") if cluster else body).isNotNull().alias("has_cluster"),
            F.xxhash64(body).alias("h"),
            F.xxhash64(F.col(f"`{key}`")).alias("d"),
            # tells repeated rows apart, so that they spread over groups
            F.monotonically_increasing_id().alias("r"),
        ),
        "pack-items",
    )
    groups = max(1, round(items.count() / group))
    dealt = items.select(
        # as text, because a column of numbers with nulls would turn into floats
        F.col("doc_id").cast("string").alias("doc_id"),
        "n_words",
        F.when(F.col("has_source"), F.col("source_hash").cast("string")).alias("source"),
        F.when(F.col("has_cluster"), F.col("cluster_hash").cast("string")).alias("cluster"),
        "h",
        "d",
        "r",
        F.pmod(F.xxhash64("d", "h", "r"), F.lit(groups)).alias("pack_group"),
    )
    kind = docs.schema[key].dataType.simpleString()
    return dealt.groupBy("pack_group").applyInPandas(
        kernels.packer(capacity),
        "doc_id string, piece int, start_word bigint, n_words bigint, bin bigint, offset bigint",
    ).withColumn("doc_id", F.col("doc_id").cast(kind))
