"""Substring dedup: runs of consecutive sentences that stand elsewhere are taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm import cutting
from groveline.llm.columns import drop_table, kept_table
from groveline.llm.components import with_least

FEWEST = 3
LEAST_WORDS = 20
LONGEST = 12


def cut_table(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    fewest: int = FEWEST,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
) -> DataFrame:
    """(doc_id, d, h, n_units, units, spans), written once.

    ``d`` and ``h`` are hashes of key and text, ``n_units`` is the number of units, ``spans``
    the hashes of the runs from each unit on, ``units`` their lengths.
    """
    body, k = F.col(f"`{text}`"), F.col(f"`{key}`")
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(k.alias("doc_id"), F.xxhash64(k).alias("d"), F.xxhash64(body).alias("h"), body.alias("text"))
    cut = named.mapInArrow(
        cutting.cutter(fewest, least_words, longest),
        f"doc_id {kind}, d bigint, h bigint, n_units int, units array<int>, spans array<bigint>",
    )
    return kept_table(cut, "cut-texts")


def repeated_spans(cut: DataFrame, used: list[DataFrame] | None = None) -> DataFrame:
    """(doc_id, h, start, units, first_doc): spans of a cut table that stand before in the corpus.

    Of equal spans the first is that with the smallest key, then text hash, then place; null
    keys last. Spans that stand once are told by counts of their hashes and need
    not move with their place. A hash with a large share of all spans meets its
    count, and its first place, by broadcast. The tables written on the way are added to
    ``used``.
    """
    counted = (
        cut.select(F.explode("spans").alias("u"))
        .groupBy("u")
        .agg(F.lit(0).alias("m"), F.count(F.lit(1)).alias("n"))
    )
    twice = kept_table(counted.where("n > 1"), "repeated-spans")
    total = cut.agg(F.sum(F.size("spans"))).first()[0] or 0
    listed = cut.select("doc_id", "h", F.posexplode(F.arrays_zip("spans", "units")).alias("start", "s"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "start", F.col("s.units").alias("units"))
    places = listed.select(F.col("s.spans").alias("u"), place.alias("v"))
    met = kept_table(with_least(places, twice, total).select("u", "v"), "repeated-places")
    first = kept_table(
        met.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "first-places"
    )
    if used is not None:
        used += [twice, met, first]
    return (
        with_least(met, first, total)
        .where("v.none <> m.none OR v.h <> m.h OR v.start <> m.start OR NOT v.doc_id <=> m.doc_id")
        .select("v.doc_id", "v.h", "v.start", "v.units", F.col("m.doc_id").alias("first_doc"))
    )


def drop_repeated_spans(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    fewest: int = FEWEST,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, first_docs), one row per input row.

    A text is cut at ends of sentences and clauses, and stretches of more than ``longest``
    words at words of locally least hash, so that a passage is cut alike wherever it stands. From every such unit the
    shortest run of ``fewest`` or more units with ``least_words`` or more words is
    hashed (lower-cased, blanks alike). Units covered by a run that stands before in the
    corpus are taken out of the text; ``first_docs`` lists where those runs stand first.

    A null text stays null; a text may become empty. Rows that repeat both key and text
    are one document: they lose the same units. An empty table gives no row. Other
    columns are left out.
    """
    body, k = F.col(f"`{text}`"), F.col(f"`{key}`")
    kind = docs.schema[key].dataType.simpleString()
    cut = cut_table(docs, key=key, text=text, fewest=fewest, least_words=least_words, longest=longest)
    used = [cut]
    found = repeated_spans(cut, used).select(
        F.xxhash64("doc_id").alias("d"),
        "h",
        F.lit(None).cast("int").alias("n_units"),
        F.struct("start", "units").alias("gone"),
        "first_doc",
    )
    # one row per document: its units, and its own repeated spans, no more than it has units
    own = cut.select("d", "h", "n_units", F.lit(None).alias("gone"), F.lit(None).alias("first_doc"))
    losses = kept_table(
        own.unionByName(found)
        .groupBy("d", "h")
        .agg(
            F.max("n_units").cast("bigint").alias("n_sentences"),
            F.collect_list("gone").alias("gone"),
            F.array_sort(F.collect_set("first_doc")).alias("first_docs"),
        ),
        "losses",
    )
    for table in used:  # the result reads only the losses
        drop_table(table)
    texts = docs.select(k.alias("doc_id"), body.alias("text"), F.xxhash64(k).alias("d"), F.xxhash64(body).alias("h"))
    joined = texts.join(losses, ["d", "h"]).select(
        "doc_id", "text", F.col("first_docs").cast(f"array<{kind}>").alias("first_docs"), "n_sentences", "gone"
    )
    done = joined.mapInArrow(
        cutting.span_remover(longest),
        f"doc_id {kind}, first_docs array<{kind}>, n_sentences bigint, text string, n_removed bigint",
    )
    return done.select("doc_id", "text", "first_docs", "n_sentences", "n_removed")
