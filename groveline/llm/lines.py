"""Line dedup: lines that stand on too large a share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.llm import kernels
from groveline.llm.columns import kept_table
from groveline.llm.components import with_least

RATIO = 0.08
MIN_PAGES = 3
ADDED = "boilerplate_lines"
# Boilerplate lines of all hosts together that may be broadcast, 16 bytes each.
_BROADCAST_LINES = 1_000_000
# A host with more than one row in so many is hot; there are fewer such hosts than that.
_MOST_HOT = 1000
_BLANKS = " \t\n\x0b\x0c\r"


def _line_id(line: Column) -> Column:
    """128 bits that stand for a line without the blanks around it."""
    trimmed = F.btrim(line, F.lit(_BLANKS))
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit("line"), trimmed).alias("b"))


def _is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) == ""


def _counts(docs: DataFrame, host: str, text: str, once: bool) -> tuple[DataFrame, DataFrame]:
    """(host, line, n) and (host, pages): the pages with a line, and all pages of a host."""
    ids = F.array_distinct(
        F.transform(F.filter(F.split("text", "\n"), lambda x: ~_is_blank(x)), _line_id)
    )
    pages = docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")).where(
        F.col("host").isNotNull()
    )
    one = F.count(F.lit(1))
    # partial counts per task come first, so neither a hot line nor a hot host meets in one task
    if not once:
        on = pages.select("host", F.explode(ids).alias("line")).groupBy("host", "line").agg(one.alias("n"))
        return on, pages.groupBy("host").agg(one.alias("pages"))

    minima = F.pandas_udf(kernels.page_minima, "s0 long, s1 long, s2 long, s3 long")("text")
    marked = pages.select("host", minima.alias("s"), ids.alias("lines"))
    bodies = kept_table(
        marked.select("host", "s.*", F.xxhash64("host", "s.s0", "s.s1", "s.s2", "s.s3").alias("body"), "lines"),
        "page-lines",
    )
    named = _copies(bodies.select("host", "body", "s0", "s1", "s2", "s3").distinct())

    def of_groups(rows: DataFrame, by: list[str], n: str) -> DataFrame:
        # distinct before the join, so a hot group of copies is a few rows there
        return rows.distinct().join(named, "body").select(*by, "copy").distinct().groupBy(*by).agg(one.alias(n))

    on = of_groups(bodies.select("host", "body", F.explode("lines").alias("line")), ["host", "line"], "n")
    return on, of_groups(bodies.select("host", "body"), ["host"], "pages")


def _copies(bodies: DataFrame) -> DataFrame:
    """(body, copy): what exact and near copies on a host have in common.

    ``bodies`` has a row for each host and quadruple of least shingle values. Of two texts
    each value is equal with the probability of their share of common shingles. The name of a
    page is its first value; then, for one value after the other, pages with the same
    value take the least of their names. So a page whose first value an edit changed gets the
    name of its group by any of the others.
    """
    named = kept_table(bodies.withColumn("copy", F.col("s0")), "named-0")
    n = named.count()
    for s in ("s1", "s2", "s3", "s0"):
        ends = named.select(F.struct("host", s).alias("u"), F.struct(*named.columns).alias("v"))
        least = kept_table(
            ends.groupBy("u").agg(F.min("v.copy").alias("m"), F.count(F.lit(1)).alias("n")), "least-names"
        )
        columns = [F.col(f"v.{c}") for c in named.columns if c != "copy"]
        named = kept_table(with_least(ends, least, n).select(*columns, F.col("m").alias("copy")), "named")
    return named.select("body", "copy")


def boilerplate(
    docs: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """(host, lines): ids of the lines on more than ``ratio`` of a host's pages.

    A host has few of them, at most the mean number of lines of its pages over ``ratio``,
    so its array is bounded by the pages, not by their number.
    """
    on, totals = _counts(docs, host, text, copies_once)
    frequent = on.where(F.col("n") >= min_pages).join(totals, "host")
    return (
        frequent.where(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"))
    )


def _beside(docs: DataFrame, host: str, found: DataFrame) -> DataFrame:
    """``docs`` with the ``lines`` (null for none) of their host as ``__line_dedup_lines``.

    So few lines that they take 16 MB at most are broadcast. Beyond that hosts with a large share of all
    rows meet theirs by broadcast, and the rows of all others are shuffled.
    """
    name, lines = "__line_dedup_host", "__line_dedup_lines"
    found = found.select(F.col("host").alias(name), F.col("lines").alias(lines))
    if (found.agg(F.sum(F.size(lines))).first()[0] or 0) <= _BROADCAST_LINES:
        return docs.join(F.broadcast(found), docs[f"`{host}`"] == F.col(name), "left")
    sizes = docs.groupBy(F.col(f"`{host}`").alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    hot = kept_table(
        sizes.where((F.col("n") * _MOST_HOT > total) & F.col(name).isNotNull())
        .join(found, name, "left")
        .select(name, lines, F.lit(True).alias("__line_dedup_hot")),
        "hot-hosts",
    )
    marked = docs.join(F.broadcast(hot), docs[f"`{host}`"] == F.col(name), "left")
    stay = marked.where("__line_dedup_hot").drop("__line_dedup_hot")
    move = marked.where("__line_dedup_hot IS NULL").drop(name, lines, "__line_dedup_hot")
    moved = move.join(found, move[f"`{host}`"] == F.col(name), "left")
    return stay.select([f"`{c}`" for c in moved.columns]).unionAll(moved)


def drop_boilerplate(
    docs: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """All rows and columns, ``text`` without its site's boilerplate lines.

    ``boilerplate_lines``, the number of lines taken out, is added, in place of any column
    of that name.

    A page is a row, so repeated rows are repeated pages, unless ``copies_once``: then exact
    and near copies, as told by the least of their five-word shingles, are one page of a host,
    with the lines of all of them, so that no group of copies makes boilerplate of its own
    text. A line counts once per page,
    blanks around it do not matter, and blank lines always stay. Pages without a host
    belong to no site: nothing is taken from them. A null text stays null, a text may
    become empty. An empty table gives no row.
    """
    found = kept_table(
        boilerplate(
            docs, host=host, text=text, ratio=ratio, min_pages=min_pages, copies_once=copies_once
        ),
        "boilerplate",
    )
    joined = _beside(docs, host, found)
    split = joined.withColumn("__line_dedup_split", F.split(F.col(f"`{text}`"), "\n"))
    kept = F.filter(
        "__line_dedup_split", lambda x: _is_blank(x) | ~F.array_contains(F.col("__line_dedup_lines"), _line_id(x))
    )
    cut = split.withColumn("__line_dedup_kept", F.when(F.col("__line_dedup_lines").isNull(), F.col("__line_dedup_split")).otherwise(kept))
    n_dropped = F.coalesce(F.size("__line_dedup_split") - F.size("__line_dedup_kept"), F.lit(0)).cast("bigint")
    new_text = F.when(n_dropped > 0, F.array_join("__line_dedup_kept", "\n")).otherwise(F.col(f"`{text}`"))
    return cut.select(
        *[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != ADDED],
        F.when(F.col(f"`{text}`").isNull(), 0).otherwise(n_dropped).cast("bigint").alias(ADDED),
    )
