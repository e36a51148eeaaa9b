"""Sharding by histogram sort: exact splitters first, then one exchange."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveline.llm.columns import kept_table

SHARDS = 16
TOLERANCE = 0.005
ROWS_PER_PART = 1_000_000
# Parts in which shards are sorted, at most: what the driver holds is bounded by them.
MOST_PARTS = 256
_LEVELS = ("h", "d", "r")
_LOW, _HIGH = -(2**63), 2**63
_FIRST_BITS, _NEXT_BITS = 12, 6


@dataclass
class _Target:
    """A wished boundary: so much of ``measure`` is to lie below it."""

    measure: str
    wish: float
    tolerance: float
    # while open: the candidate interval, all keys that begin with ``prefix`` and whose next
    # level shifted right by ``width`` bits is ``place``, and what lies below it
    prefix: tuple[int, ...] = ()
    place: int = 0
    below: dict = field(default_factory=lambda: {"bytes": 0, "rows": 0})
    # once found: the first key above, None if none is
    found: tuple[int, ...] | None = None
    done: bool = False


def sort_keys(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, size, h, d, r): each row whole, its size, and its sort key: text hash, key hash, row number.

    Equal texts are neighbours. The row number decides between repeated rows only; the
    table is written once, which fixes it.
    """
    body = F.col(f"`{text}`")
    return kept_table(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.xxhash64(body).alias("h"),
            F.xxhash64(F.col(f"`{key}`")).alias("d"),
            F.monotonically_increasing_id().alias("r"),
        ),
        "shard-keys",
    )


def _after(prefix: tuple[int, ...], start: int) -> tuple[int, ...] | None:
    """The key with which an interval starts; past the end of a level the one before moves on."""
    if start < _HIGH:
        return (*prefix, start)
    return _after(prefix[:-1], prefix[-1] + 1) if prefix else None


def _in_open(level: int, width: int, targets: list[_Target]) -> Column:
    """Whether a row lies in an open candidate interval."""
    column = F.col(_LEVELS[level])
    places: dict[tuple, set] = {}
    for t in targets:
        places.setdefault(t.prefix, set()).add(t.place)
    inside = F.lit(False)
    for prefix, found in places.items():
        held = F.shiftright(column, width).isin(sorted(found)) if width < 64 else F.lit(True)
        for name, value in zip(_LEVELS, prefix):
            held = held & (F.col(name) == F.lit(value))
        inside = inside | held
    return inside


def _probe(keys: DataFrame, level: int, width: int, bits: int, targets: list[_Target]) -> None:
    """Count bytes and rows between the probes of all open intervals, and narrow those down."""
    narrow = width - bits
    by = [*_LEVELS[:level], F.shiftright(F.col(_LEVELS[level]), narrow).alias("place")]
    counted = (
        keys.where(_in_open(level, width, targets))
        .groupBy(*by)
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .collect()  # as many rows as there are probes, at most
    )
    by_interval: dict[tuple, list] = {}
    for row in sorted(counted, key=lambda row: row["place"]):
        at = (tuple(row[: level]), row["place"] >> bits if width < 64 else 0)
        by_interval.setdefault(at, []).append(row)
    for t in targets:
        below = dict(t.below)
        for row in by_interval.get((t.prefix, t.place), []):
            above = {m: below[m] + row[m] for m in below}
            if above[t.measure] > t.wish:
                break
            below = above
        else:  # nothing is left above the wish: the boundary is the end of the interval
            row = None
        if row is None:
            end = (t.place + 1) << width if width < 64 else _HIGH
            t.found, t.below, t.done = _after(t.prefix, end), below, True
            continue
        start, end = row["place"] << narrow, (row["place"] + 1) << narrow
        short, over = t.wish - below[t.measure], above[t.measure] - t.wish
        last = narrow == 0 and level == len(_LEVELS) - 1
        if last or min(short, over) <= t.tolerance:
            lower = short <= over
            t.found = _after(t.prefix, start if lower else end)
            t.below, t.done = (below if lower else above), True
        elif narrow == 0:
            t.prefix, t.place, t.below = (*t.prefix, row["place"]), 0, below
        else:
            t.place, t.below = row["place"], below


def splitters(keys: DataFrame, targets: list[_Target]) -> None:
    """Refine probes, level by level of the sort key, until every target meets its tolerance."""
    for level in range(len(_LEVELS)):
        width = 64
        while width > 0:
            waiting = [t for t in targets if not t.done and len(t.prefix) == level]
            if not waiting:
                break
            bits = _FIRST_BITS if width == 64 else min(_NEXT_BITS, width)
            _probe(keys, level, width, bits, waiting)
            width -= bits


def _part(bounds: list[tuple[int, ...]]) -> Column:
    """How many bounds are at or below the row's key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    filled = [(*b, *[_LOW] * (len(_LEVELS) - len(b))) for b in bounds]
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(_LEVELS, b)]) for b in filled])
    own = F.struct(*_LEVELS)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def search(at: Column, step: Column) -> Column:
        reached = F.coalesce(F.get(listed, at + step - 1) <= own, F.lit(False))
        return F.when(reached, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), search)


def deal(
    docs: DataFrame,
    shards: int = SHARDS,
    *,
    key: str = "doc_id",
    text: str = "text",
    tolerance: float = TOLERANCE,
    rows_per_part: int = ROWS_PER_PART,
    most_parts: int = MOST_PARTS,
) -> DataFrame:
    """(row, size, shard, slot): all rows, whole, dealt into shards of nearly equal bytes.

    ``row`` is a struct of all columns. A row's size is the UTF-8 bytes of its text and
    one more; a null text has none. Rows
    are sorted by text hash, key hash and row number. Exact counts of bytes below probes,
    refined until within ``tolerance`` of a shard's size, give the splitters. Equal texts
    stay in one shard where a boundary between texts meets the tolerance; a larger group
    is split, by the next level of the key. Where single rows are larger than the
    tolerance the nearest boundary between rows is taken.

    ``slot`` numbers a shard's rows in sort order from 0. Within shards rows are cut into
    parts of about ``rows_per_part``, at most ``most_parts`` of them, by splitters of the
    same kind, so that no task sorts a whole shard; the exact counts below each part give
    its first slot. Each row moves once, to its part.

    Null keys and repeated rows are rows like any other; an empty table gives no row.
    """
    keys = sort_keys(docs, key=key, text=text)
    total = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    n_bytes, n_rows = total["bytes"] or 0, total["rows"]
    mean = n_bytes / shards
    by_bytes = [_Target("bytes", mean * j, mean * tolerance) for j in range(1, shards)]
    parts = min(most_parts, math.ceil(n_rows / rows_per_part))
    by_rows = [
        _Target("rows", n_rows * j / parts, n_rows / parts / 4) for j in range(1, parts)
    ]
    splitters(keys, by_bytes + by_rows)
    first = (_LOW,)
    starts = [first, *[t.found for t in by_bytes]]
    rows_below = {first: 0} | {t.found: t.below["rows"] for t in by_bytes + by_rows if t.found}
    bounds = sorted(rows_below)
    # of shards that start at the same key all but the last are empty
    shard_of = [max(j for j, s in enumerate(starts) if s is not None and s <= b) for b in bounds]
    slot_of = [rows_below[b] - rows_below[starts[s]] for b, s in zip(bounds, shard_of)]
    order = F.row_number().over(Window.partitionBy("part").orderBy(*_LEVELS))
    placed = keys.withColumn("part", _part(bounds[1:]))
    return placed.withColumn("order", order).select(
        "row",
        "size",
        F.get(F.array(*map(F.lit, shard_of)), F.col("part")).alias("shard"),
        (F.get(F.array(*[F.lit(s).cast("bigint") for s in slot_of]), F.col("part")) + F.col("order") - 1)
        .cast("bigint")
        .alias("slot"),
    )


def shard(docs: DataFrame, shards: int = SHARDS, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of the rows as ``deal`` deals them.

    The checksum is that of the text that arrived in the shard. Extra columns are left out,
    so that their names cannot clash.
    """
    dealt = deal(docs, shards, key=key, text=text, **options)
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    return dealt.select(
        F.col("row").getField(key).alias("doc_id"),
        "size",
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
