"""Benchmark decontamination: fingerprints of item-sized windows, met by a multi-index, then exact similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveline.llm.columns import kept_table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
_BLOCK_BITS = (13, 13, 13, 13, 12)
_BROADCAST_ROWS = 4_000_000
_TOKEN = r"[\p{L}\p{N}]+"


def _with_shingles(table: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` and the array ``g``: the hash of every run of five words, in order."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    h = table.select(*keep, F.transform(tokens, lambda w: F.xxhash64(w)).alias("w"))
    length = F.greatest(F.size("w") - (SHINGLE - 1), F.lit(0))
    moved = [F.slice("w", k + 1, length) for k in range(SHINGLE)]
    return h.select(*keep, F.transform(F.arrays_zip(*moved), lambda five: F.xxhash64(five)).alias("g"))


_COUNTERS = [f"s{i}" for i in range(32)]


def _counters(g: Column) -> list[Column]:
    """What a shingle adds to the counters of the 64 bits, of which each bigint holds two.

    Counter i is that of bit i, and from its 32nd bit on that of bit i + 32; so 32 sums
    count all bits of up to two thousand million shingles.
    """
    low = [F.shiftrightunsigned(g, i).bitwiseAND(1) for i in range(64)]
    return [low[i] + F.shiftleft(low[i + 32], 32) for i in range(32)]


def _fingerprint(total: Column) -> Column:
    """The SimHash of summed counters s0 to s31: a bit is set if over half of the total has it."""

    def bit(i: int) -> Column:
        s = F.col(_COUNTERS[i % 32])
        ones = s.bitwiseAND(0xFFFFFFFF) if i < 32 else F.shiftrightunsigned(s, 32)
        return F.when(2 * ones > total, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(
            F.lit(0).cast("bigint")
        )

    parts = [bit(i) for i in range(64)]
    while len(parts) > 1:  # a shallow tree instead of a chain of 64
        parts = [
            parts[i].bitwiseOR(parts[i + 1]) if i + 1 < len(parts) else parts[i]
            for i in range(0, len(parts), 2)
        ]
    return parts[0]


def simhash(shingled: DataFrame, by: list[str]) -> DataFrame:
    """(by, fp, total) of rows (by, g, n): shingles with their counts."""
    sums = [F.sum(c * F.col("n")).alias(s) for c, s in zip(_counters(F.col("g")), _COUNTERS)]
    counted = shingled.groupBy(*by).agg(F.sum("n").alias("total"), *sums)
    return counted.select(*by, _fingerprint(F.col("total")).alias("fp"), "total")


def _over_windows(hits: DataFrame, windows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``windows`` (d, h, size, start, stop) with sums over the ``hits`` (d, h, at, g) inside.

    Hits and the edges of windows lie on one line per text; running totals along it are
    read at both edges, so the work is linear in hits and windows.
    """
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("int")
    points = hits.select(
        "d", "h", F.col("at").alias("pos"), F.lit(1).alias("kind"), *[c.cast("bigint").alias(n) for n, c in sums.items()],
        *[none.alias(c) for c in ("size", "start", "stop", "sign")],
    )
    edge = F.explode(
        F.array(
            F.struct(F.col("start").alias("pos"), F.lit(-1).alias("sign")),
            F.struct(F.col("stop").alias("pos"), F.lit(1).alias("sign")),
        )
    )
    edges = windows.select("d", "h", "size", "start", "stop", edge.alias("e")).select(
        "d", "h", "e.pos", F.lit(0).alias("kind"), *[zero.alias(n) for n in sums], "size", "start", "stop", "e.sign"
    )
    # an edge comes before a hit at its place, so the hit counts from there on
    line = Window.partitionBy("d", "h").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    read = points.unionByName(edges).select(
        "d", "h", "size", "start", "stop", "sign", *[F.sum(n).over(line).alias(n) for n in sums]
    )
    return (
        read.where("sign IS NOT NULL")
        .groupBy("d", "h", "size", "start", "stop")
        .agg(*[F.sum(F.col(n) * F.col("sign")).alias(n) for n in sums])
    )


def _blocks(fp: Column) -> Column:
    """The fingerprint cut into blocks, as (block, value)."""
    found, start = [], 0
    for j, width in enumerate(_BLOCK_BITS):
        value = F.shiftrightunsigned(fp, start).bitwiseAND((1 << width) - 1).cast("int")
        found.append(F.struct(F.lit(j).alias("block"), value.alias("value")))
        start += width
    return F.array(*found)


def _flips(radius: int) -> dict[int, list[int]]:
    """For each block width the patterns of bits to flip, up to ``radius // blocks`` bits.

    Two fingerprints within the radius differ in no more than that in one block at
    least, so an index under all flipped values cannot miss one.
    """
    most = radius // len(_BLOCK_BITS)
    return {
        width: [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)]
        for width in set(_BLOCK_BITS)
    }


def near_items(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(w, item) for all windows (w, size, fp) and items (item, size, fp) of the same size
    whose fingerprints differ in at most ``radius`` bits, by a multi-index over blocks."""
    flips = _flips(radius)
    indexed = items.select("item", "size", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"))).alias("b"))
    near_values = [
        F.when(F.col("b.block") == j, F.array(*[F.lit(m) for m in flips[width]]))
        for j, width in enumerate(_BLOCK_BITS)
    ]
    listed = indexed.select(
        "item",
        "size",
        "item_fp",
        F.col("b.block").alias("block"),
        F.col("b.value").alias("own"),
        F.explode(F.coalesce(*near_values)).alias("flip"),
    ).select("item", "size", "item_fp", "block", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
    # some 1,800 rows for each item: once written, its size tells whether it may be broadcast
    index = kept_table(listed, "fingerprint-index")
    asked = windows.select("w", "size", "fp", F.inline(_blocks(F.col("fp"))))
    return (
        asked.join(index, ["size", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("w", "item")
        .distinct()
    )


def _best_windows(chosen: DataFrame, hits: DataFrame, places: DataFrame, similarity: float) -> DataFrame:
    """(d, h, c, best): for texts and contents ``chosen`` the best window, if it is good enough.

    Exact, and linear in the hits: a hit adds to what a window shares with the content if
    it lies inside and fewer than the content's number of equal ones lie before it there.
    So it counts for the starts in one stretch, and running totals give what each window
    shares. A best window starts at a shared shingle, or at the text's start and ends
    behind one.
    """
    pair = ["d", "h", "c"]
    shared = chosen.join(hits, ["d", "h"]).join(
        places.select("c", "g", "size", F.size("places").alias("cap")), ["c", "g"]
    )
    equal = Window.partitionBy(*pair, "g").orderBy("at")
    numbered = shared.withColumn("rn", F.row_number().over(equal))
    earlier = numbered.select(*pair, "g", F.col("at").alias("before"), (F.col("rn") + F.col("cap")).alias("rn"))
    reached = numbered.join(earlier, [*pair, "g", "rn"], "left")
    first = F.greatest(F.coalesce(F.col("before"), F.lit(-(1 << 30))), F.col("at") - F.col("size")) + 1

    def event(pos: Column, kind: int, n: int) -> Column:
        return F.struct(pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), F.lit(n).alias("n"))

    events = reached.select(
        *pair, "size", "most", "at", "rn", "cap",
        F.explode(F.array(event(first, 0, 1), event(F.col("at") + 1, 0, -1), event(F.col("at"), 1, 0))).alias("e"),
    )
    line = Window.partitionBy(*pair).orderBy("e.pos", "e.kind").rowsBetween(Window.unboundedPreceding, 0)
    is_start = F.col("e.kind") == 1
    laid = events.select(
        *pair, "size", "most", "at", "e.kind",
        F.sum("e.n").over(line).alias("whole"),
        F.sum(F.when(is_start & (F.col("rn") <= F.col("cap")), 1).otherwise(0)).over(line).alias("lead"),
    ).where("kind = 1")
    stop = F.least(F.col("at") + F.col("size"), F.col("most"))
    windows = laid.select(
        *pair, "size",
        F.inline(
            F.array(
                F.struct(F.col("at").alias("start"), stop.alias("stop"), F.col("whole").alias("both")),
                # cut at the text's start
                F.struct(
                    F.lit(0).alias("start"),
                    (F.col("at") + 1).alias("stop"),
                    F.when(F.col("at") + 1 < F.col("size"), F.col("lead")).otherwise(0).alias("both"),
                ),
            )
        ),
    )
    either = F.col("stop") - F.col("start") + F.col("size") - F.col("both")
    rated = windows.withColumn("similarity", F.col("both") / either).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", "start", (-F.col("stop")).alias("end")))
    return rated.groupBy(*pair).agg(best.alias("best"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """(doc_id, h, item_id, start_word, n_words, similarity): passages of benchmark items in texts.

    Words are runs of letters and digits in lower case; shingles are five words. Windows
    have the size of an item, lie anywhere in the text, and are cut where they reach over
    an end of it. The similarity is the sum of the smaller over the sum of the greater
    counts of each shingle. One row per text and item, with the best window, if it reaches
    ``similarity``; of equally good ones that which starts last, and is shortest.

    Windows that hold enough of the benchmark's shingles for the similarity get a
    fingerprint of those, and a multi-index over blocks of bits finds every item of their
    size within ``radius`` bits. Fingerprints follow the angle between counts; where a
    shingle repeats, that can be far wider than the similarity says. Items with a repeated
    shingle, and texts that repeat one of the benchmark's, are therefore also compared with
    what shares one of an item's rarest shingles, of which a good window must hold one. All
    candidates of either kind are compared exactly.

    ``h`` is the text's hash, which with the key tells rows apart; rows that repeat both
    are one text, or one item. Items of fewer than five words have no shingle and match
    nothing, nor do null and empty texts. Null keys and item ids are like any others.
    Empty tables give no row. Other columns are left out.
    """
    body = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("h"),
        F.xxhash64(F.col(f"`{key}`")).alias("d"),
        F.col(f"`{text}`").alias("text"),
    )
    given = benchmark.select(
        F.col(f"`{item}`").alias("item_id"),
        F.struct(F.xxhash64(F.col(f"`{item}`")).alias("i"), F.xxhash64(F.col(f"`{item_text}`")).alias("t")).alias("item"),
        F.col(f"`{item_text}`").alias("item_text"),
    ).dropDuplicates(["item"])
    # copies of an item are one content, c; an item's size is its number of shingles
    content = F.struct(F.xxhash64("g").alias("a"), F.xxhash64(F.lit("item"), "g").alias("b"))
    shingled = kept_table(
        _with_shingles(given, "item_text", "item_id").where(F.size("g") > 0).select("item_id", content.alias("c"), "g"),
        "items",
    )
    contents = shingled.select("c", "g").dropDuplicates(["c"])
    # (c, size, g, places): where each content has each of its shingles
    places = kept_table(
        contents.select("c", F.size("g").alias("size"), F.posexplode("g").alias("place", "g"))
        .groupBy("c", "size", "g")
        .agg(F.collect_list("place").alias("places")),
        "item-shingles",
    )
    spread = kept_table(places.groupBy("g").agg(F.count(F.lit(1)).alias("n_items")), "known-shingles")
    # the rarest shingles of a content that outweigh what a window may lack
    rarest = Window.partitionBy("c").orderBy("n_items", "g").rowsBetween(Window.unboundedPreceding, -1)
    lacking = (1 - similarity) * F.col("size") + 1e-9
    asked = kept_table(
        places.join(spread, "g")
        .withColumn("before", F.coalesce(F.sum(F.size("places")).over(rarest), F.lit(0)))
        .where(F.col("before") <= lacking)
        .select("g", "c", "size"),
        "rarest-shingles",
    )

    # where texts share a shingle with the benchmark: the one pass over all texts
    known = spread.select("g")
    if known.count() <= _BROADCAST_ROWS:
        known = F.broadcast(known)
    # the outer form, since Spark puts a filter of its own before the inner one and computes
    # the shingles for both; the row that it adds for an empty text joins nothing
    positions = _with_shingles(body, "text", "doc_id", "d", "h").select(
        "doc_id", "d", "h", F.size("g").alias("most"), F.posexplode_outer("g").alias("at", "g")
    )
    met = kept_table(positions.join(known, "g", "left_semi"), "shared-shingles")
    # repeated rows are one text
    hits = kept_table(met.select("d", "h", "most", "at", "g").distinct(), "hits")
    near = kept_table(
        hits.join(asked, "g").select("d", "h", "most", "c", "size").distinct(), "texts-near-items"
    )

    # windows of every size that can be in the text, from each shared shingle on, and cut at the start
    most_sizes = near.select("d", "h", "size").distinct()
    at, size = F.col("at"), F.col("size")
    begun = F.struct(at.alias("start"), F.least(at + size, F.col("most")).alias("stop"))
    cut = F.struct(F.lit(0).alias("start"), (at + 1).alias("stop"))
    windows = (
        hits.join(most_sizes, ["d", "h"])
        .select("d", "h", "size", F.inline(F.when(at + 1 < size, F.array(begun, cut)).otherwise(F.array(begun))))
        .distinct()
    )
    enough = F.lit(similarity / (1 + similarity)) * (F.col("stop") - F.col("start") + size) - 1e-9
    full = kept_table(
        _over_windows(hits, windows, {"n": F.lit(1)}).where(F.col("n") >= enough), "full-windows"
    )
    weighed = hits.join(full.select("d", "h").distinct(), ["d", "h"], "left_semi")
    counters = dict(zip(_COUNTERS, _counters(F.col("g"))))
    printed = _over_windows(weighed, full, {"n": F.lit(1), **counters}).select(
        F.struct("d", "h").alias("w"), "size", _fingerprint(F.col("n")).alias("fp")
    )
    weights = places.select("c", "size", "g", F.size("places").alias("n"))
    item_prints = simhash(weights, ["c", "size"]).select(F.col("c").alias("item"), "size", "fp")
    by_print = near_items(printed.distinct(), item_prints, radius).select("w.d", "w.h", F.col("item").alias("c"))

    # the exact way beside it, where shingles repeat
    of_items = places.where(F.size("places") > 1).select("c").distinct()
    of_texts = hits.groupBy("d", "h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "h").distinct()
    candidates = near.select("d", "h", "c")
    by_shingle = candidates.join(of_items, "c", "left_semi").select("d", "h", "c").unionByName(
        candidates.join(of_texts, ["d", "h"], "left_semi")
    )
    chosen = kept_table(by_print.unionByName(by_shingle).distinct(), "candidates")
    best = _best_windows(chosen, hits, places, similarity)
    keys = met.select("doc_id", "d", "h").distinct()
    return best.join(keys, ["d", "h"]).join(shingled.select("c", "item_id"), "c").select(
        "doc_id",
        "h",
        "item_id",
        F.col("best.start").cast("bigint").alias("start_word"),
        (-F.col("best.end") - F.col("best.start") + (SHINGLE - 1)).cast("bigint").alias("n_words"),
        F.col("best.similarity").alias("similarity"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of documents in which no item of the benchmark was found, all columns."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    found = kept_table(
        contaminated(docs, benchmark, **options)
        .select(F.xxhash64("doc_id").alias("d"), "h")
        .distinct(),
        "contaminated",
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hashed = docs.select(
        F.xxhash64(F.col(f"`{key}`")).alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("h"), row
    )
    return hashed.join(found, ["d", "h"], "left_anti").select(
        [F.col("row").getField(c).alias(c) for c in docs.columns]
    )
