"""Near-dedup by SimHash: tiled exact comparison of fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm import kernels
from groveline.llm.columns import kept_table
from groveline.llm.components import components, with_least

RADIUS = 4
_BUCKET = 8192
_MOST_BITS = 12
_CHUNK = 32768


def fingerprint_table(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, d, h, fp), written once: the key, hashes of key and text, the fingerprint."""
    simhash = F.pandas_udf(kernels.fingerprints, "long")
    body = F.col(f"`{text}`")
    return kept_table(
        docs.select(
            F.col(f"`{key}`").alias("doc_id"),
            F.xxhash64(F.col(f"`{key}`")).alias("d"),
            F.xxhash64(body).alias("h"),
            simhash(body).alias("fp"),
        ),
        "fingerprints",
    )


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``radius`` bits of each other.

    ``distinct`` has one row per fingerprint, ``fp``. Its bits are cut into radius + 1
    blocks: two fingerprints within the radius agree in one block at least, so tiles
    are formed of fingerprints that agree in (the first bits of) a block, and every
    other pair of tiles is out of the radius. Tiles are compared exactly, pair by pair;
    those whose population counts differ beyond the radius are skipped. A block value
    with many fingerprints is cut into chunks, and every pair of chunks is a group of
    its own, so a task holds two chunks at most.

    A group hands on a spanning forest of its links, never all pairs.
    """
    n = distinct.count()
    widths = [64 // (radius + 1) + (j < 64 % (radius + 1)) for j in range(radius + 1)]
    bits = [min(w, _MOST_BITS, max(0, math.ceil(math.log2(max(n, 1) / _BUCKET)))) for w in widths]
    starts = [sum(widths[: j + 1]) - bits[j] for j in range(radius + 1)]
    blocks = [
        F.struct(
            F.lit(j).alias("block"),
            F.shiftrightunsigned("fp", starts[j]).bitwiseAND((1 << bits[j]) - 1).alias("value"),
        )
        for j in range(radius + 1)
    ]
    dealt = distinct.select("fp", F.inline(F.array(*blocks)))
    # at most (radius + 1) * 2^12 rows, whatever the number of documents
    sizes = dealt.groupBy("block", "value").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(_CHUNK)).cast("int").alias("chunks")
    )
    chunked = dealt.join(F.broadcast(sizes), ["block", "value"]).withColumn(
        "chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    paired = chunked.select("fp", "block", "value", "chunk", other).select(
        "fp",
        "block",
        "value",
        "chunk",
        F.least("chunk", "other").alias("first"),
        F.greatest("chunk", "other").alias("second"),
    )
    return paired.groupBy("block", "value", "first", "second").applyInPandas(
        kernels.tile_links(radius), "u bigint, v bigint"
    )


def classes(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, copies, component_id, rep) for every fingerprint of a fingerprint table.

    ``root`` stands for the component, ``component_id`` is its smallest key, and ``rep``
    the hashes of the row that stays of it: of those with the smallest key (null last),
    the one with the smallest text hash.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "d")
    distinct = kept_table(
        marked.groupBy("fp").agg(
            F.min("doc_id").alias("least"), F.min(own).alias("rep"), F.count(F.lit(1)).alias("copies")
        ),
        "distinct-fingerprints",
    )
    tied = components(links(distinct.select("fp"), radius))
    rooted = kept_table(
        distinct.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", "rep", "copies", F.coalesce("root", "fp").alias("root")
        ),
        "rooted-fingerprints",
    )
    # a component with a large share of the fingerprints meets its class by broadcast
    found = F.struct(F.min("least").alias("component_id"), F.min("rep").alias("rep"))
    whole = kept_table(
        rooted.groupBy(F.col("root").alias("u")).agg(found.alias("m"), F.count(F.lit(1)).alias("n")), "classes"
    )
    ends = rooted.select(F.col("root").alias("u"), F.struct("fp", "copies").alias("v"))
    return with_least(ends, whole, rooted.count()).select("v.fp", F.col("u").alias("root"), "v.copies", "m.*")


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Texts are lower-cased (A-Z), cut into words at ASCII blanks and hashed as runs of
    four words, repeats included. Fingerprints link at ``radius`` or fewer different
    bits; a component is what links reach. A null text counts as an empty one: without
    words the fingerprint is zero, which links like any other. Repeated rows share a
    component. A null key is never the smallest unless all keys of the component are
    null. An empty table gives no row. Other columns are left out.
    """
    marked = fingerprint_table(docs, key=key, text=text)
    named = kept_table(
        classes(marked, radius).select(
            F.col("fp").alias("u"), F.col("component_id").alias("m"), F.col("copies").alias("n")
        ),
        "fingerprint-classes",
    )
    # a fingerprint of many copies meets its class by broadcast
    ends = marked.select(F.col("fp").alias("u"), F.struct("doc_id").alias("v"))
    return with_least(ends, _never_null(named), marked.count()).select(
        "v.doc_id",
        F.lower(F.lpad(F.hex("u"), 16, "0")).alias("fingerprint"),
        F.col("m.id").alias("component_id"),
    )


def _never_null(named: DataFrame) -> DataFrame:
    """``m`` in a struct, since a component of null keys has a null id."""
    return named.select("u", F.struct(F.col("m").alias("id")).alias("m"), "n")


def keep_first(
    docs: DataFrame, radius: int = RADIUS, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each component with all its columns: the one with the smallest key.

    Of rows that repeat both key and text one stays.
    """
    marked = fingerprint_table(docs, key=key, text=text)
    chosen = kept_table(
        classes(marked, radius).select("rep.d", "rep.h").distinct(), "representatives"
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = docs.select(
        F.xxhash64(F.col(f"`{key}`")).alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("h"), row
    )
    return (
        hashed.join(chosen, ["d", "h"], "left_semi")
        .dropDuplicates(["d", "h"])
        .select([F.col("row").getField(c).alias(c) for c in docs.columns])
    )
