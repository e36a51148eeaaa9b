"""Quality rules: a table of thresholds, compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.llm.columns import WORD, bind, upto, words

# Frequent function words of the four languages of the corpus.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "as", "be", "on",
    "by", "at", "are", "this", "from", "or", "an", "a",
    "der", "die", "das", "und", "ist", "nicht", "den", "von", "zu", "mit", "ein", "eine", "auf",
    "für", "im", "dem", "des", "sich", "auch",
    "le", "la", "les", "de", "et", "un", "une", "du", "que", "qui", "dans", "pour", "par", "sur",
    "pas", "est", "avec", "au",
    "el", "los", "las", "en", "y", "no", "se", "del", "una", "por", "con", "para", "su", "como",
]
_STOPS = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= feature <= high``; None leaves a side open.

    The rule is for texts of at least ``from_words`` words; shorter ones pass it.
    """

    feature: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


# Defaults, in the manner of published web-corpus filters.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_length", low=2.0, high=20.0),
    Rule("symbols_per_word", high=0.1),
    Rule("exclamations_per_word", high=0.5),
    Rule("stop_word_ratio", low=0.02, from_words=25),
    Rule("letter_ratio", low=0.6, from_words=25),
    Rule("same_word_ratio", high=0.3),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def _windows(h: str) -> Column:
    """Hashes of all windows of five words, from the array of word hashes."""
    ends = F.size(h) - 4
    moved = [F.slice(h, k + 1, F.greatest(ends, F.lit(0))) for k in range(5)]
    return F.transform(F.arrays_zip(*moved), lambda five: F.xxhash64(five))


def _repeat_words(g: Column) -> Column:
    """Words in windows found twice or more, from the array of window hashes."""
    sorted_ = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p"))))

    def met_twice(s: Column) -> Column:
        def same(k: Column, other: Column) -> Column:
            return F.coalesce(F.get(s, k)["g"] == F.get(s, other)["g"], F.lit(False))

        twice = F.filter(upto(F.size(s)), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            upto(F.size(p)),
            F.lit(0).cast("bigint"),
            lambda total, k: total
            + F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(5))),
        )

    return bind(bind(sorted_, met_twice), covered)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and ratios of every text, one row per input row.

    A null text counts as an empty one: all features are 0. Other columns are left out,
    so that their names cannot clash.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        body.alias("text"),
        words(body).alias("w"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    hashed = split.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    windowed = hashed.withColumn("g", _windows("h"))
    # most texts repeat no window: for them the number of distinct ones settles it
    repeats = F.size(F.array_distinct("g")) < F.size("g")

    def n(array: str) -> Column:
        return F.size(array).cast("bigint")

    def n_where(array: str, test) -> Column:
        return F.size(F.filter(array, test)).cast("bigint")

    def chars(outside: str) -> Column:
        return F.length(F.regexp_replace("text", outside, "")).cast("bigint")

    counted = windowed.select(
        "doc_id",
        n("w").alias("n_words"),
        chars(r"[\x20\x09-\x0D]+").alias("word_chars"),
        chars(r"[^#*$%&|<>]+").alias("n_symbols"),
        n("lines").alias("n_lines"),
        (n("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(repeats, _repeat_words(F.col("g")))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("n_repeat_words"),
        chars(r"[^!]+").alias("n_exclamations"),
        chars(r"\P{L}+").alias("n_letters"),
        n_where("w", lambda x: x.isin(_STOPS)).alias("n_stop_words"),
        n_where("h", lambda x, i: x == F.get(F.col("h"), i - 1)).alias("n_same_words"),
        n_where("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]")).alias("n_bullet_lines"),
        n_where("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$")).alias("n_ellipsis_lines"),
    )
    return counted.withColumns(
        {
            "mean_word_length": _share(F.col("word_chars"), F.col("n_words")),
            "symbols_per_word": _share(F.col("n_symbols"), F.col("n_words")),
            "exclamations_per_word": _share(F.col("n_exclamations"), F.col("n_words")),
            "letter_ratio": _share(F.col("n_letters"), F.col("word_chars")),
            "same_word_ratio": _share(F.col("n_same_words"), F.col("n_words")),
            "stop_word_ratio": _share(F.col("n_stop_words"), F.col("n_words")),
            "dup_line_ratio": _share(F.col("n_dup_lines"), F.col("n_lines")),
            "bullet_line_ratio": _share(F.col("n_bullet_lines"), F.col("n_lines")),
            "ellipsis_line_ratio": _share(F.col("n_ellipsis_lines"), F.col("n_lines")),
        }
    )


def passes(rules: Sequence[Rule]) -> Column:
    """The threshold table as one condition."""
    held = F.lit(True)
    for rule in rules:
        value, inside = F.col(rule.feature), F.lit(True)
        if rule.low is not None:
            inside = inside & (value >= F.lit(rule.low))
        if rule.high is not None:
            inside = inside & (value <= F.lit(rule.high))
        held = held & (inside | (F.col("n_words") < rule.from_words))
    return held


def failed_rules(rules: Sequence[Rule]) -> Column:
    """Names of the features that break their rule, in the order of the table."""
    broken = [F.when(~passes([rule]), F.lit(rule.feature)) for rule in rules]
    return F.array_compact(F.array(*broken))


def quality(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    *,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Features and verdict of every row: ``base_failed``, ``failed`` rules and ``kept``.

    The base rule fails texts under ten words, and those of which over a fifth lies in
    repeated windows of five words. ``kept`` needs the base rule and every rule of the
    table. Null and empty texts have no word and fail. Rows are judged one by one, so
    repeated rows get equal verdicts, and an empty table gives no row. There is no
    shuffle and no user function: one pass over the texts.
    """
    judged = features(docs, key, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.withColumns({"base_failed": base, "failed": failed_rules(rules)}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of documents that pass, all their columns unchanged.

    The verdict depends on the text alone, so it is computed beside the row: the
    columns travel in a struct under a name of their own and are not read.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    # a filter would be moved below the features and compute each of them once per use;
    # it is not moved past a column that must not be computed twice
    judged = quality(packed, rules, key="row").withColumn("at", F.monotonically_increasing_id())
    good = judged.where(F.col("kept") & (F.col("at") >= 0))
    return good.select([F.col("doc_id").getField(c).alias(c) for c in docs.columns])

