"""Hard negatives: exact inner products behind intervals from rotated one-bit codes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groveline.llm.columns import kept_table
from groveline.llm.vectors import is_finite, matrix, packed, unpacked, usual_length

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIVES = 5
NEGATIVES = 3
# A negative's score, in hundredths of the positive's: at least and at most.
BAND = (50, 95)
SCALE = 256
# Rows and anchors that meet in one task at once.
ROWS = 8192
ANCHORS = 4096
# Bits of an anchor's components when it is compared with codes.
PLANES = 8
_TILE = 256


def rotation(dims: int, seed: int = 42) -> np.ndarray:
    """An orthogonal matrix, the same for the same arguments."""
    normal = np.random.default_rng(seed).standard_normal((dims, dims))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def rotated(values: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit vectors and the lengths they had; a zero vector stays zero."""
    norm = np.sqrt((values * values).sum(axis=1))
    return values / np.where(norm > 0, norm, 1.0)[:, None] @ turn, norm


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit for each component, and the alignment: the inner product of code and vector.

    The code as a vector has components of plus or minus 1 / sqrt(dims).
    """
    aligned = np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1])
    return words_of(unit >= 0), np.clip(aligned, 0.0, 1.0)


def shared_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For all pairs of rows the number of bits set in both."""
    found = np.zeros((len(left), len(right)), dtype=np.int64)
    for word in range(left.shape[1]):
        found += np.bitwise_count(left[:, word][:, None] & right[:, word][None, :])
    return found


def code_products(unit: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of all codes with the anchors in ``PLANES`` bits, and each anchor's error.

    The bit planes of an anchor meet a code by population count only.
    """
    dims = unit.shape[1]
    low = unit.min(axis=1)
    step = np.maximum(unit.max(axis=1) - low, 1e-12) / (2**PLANES - 1)
    level = np.rint((unit - low[:, None]) / step[:, None]).astype(np.int64)
    weighted = np.zeros((len(unit), len(code)), dtype=np.int64)
    for plane in range(PLANES):
        weighted += shared_bits(words_of((level >> plane) & 1 == 1), code) << plane
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    over = low[:, None] * ones[None, :] + step[:, None] * weighted
    rounded = low[:, None] + step[:, None] * level
    error = np.sqrt(((unit - rounded) ** 2).sum(axis=1))
    return (2 * over - rounded.sum(axis=1)[:, None]) / np.sqrt(dims), error


def intervals(
    unit: np.ndarray, norm: np.ndarray, code: np.ndarray, aligned: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of all anchors (unit, norm) with all coded rows.

    A unit vector is its alignment times its code plus a residual orthogonal to the code, of
    length sqrt(1 - alignment^2). With s the product of code and anchor, the code's part
    of the inner product is alignment * s, and the residual meets only what of the anchor
    is orthogonal to the code, of length sqrt(1 - s^2); Cauchy and Schwarz bound that
    product by the lengths. s is known up to the anchor's rounding error.
    """
    s, error = code_products(unit, code)
    error = error[:, None] + 1e-9
    rest = np.sqrt(1.0 - np.clip(np.abs(s) - error, 0.0, 1.0) ** 2)
    reach = aligned * error + np.sqrt(1.0 - aligned * aligned) * rest + 1e-9
    size = norm[:, None] * lengths[None, :]
    middle = aligned * s
    return (middle - reach) * size, (middle + reach) * size


def coder(dims: int):
    """A function for mapInPandas: integer components, code, alignment and length of vectors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = rotation(dims)
        for batch in batches:
            values = np.floor(SCALE * matrix(batch.pop("v"), dims))
            if len(values) and np.abs(values).max() >= 2.0**52:
                raise OverflowError("a vector's components are too large for integer scores")
            unit, norm = rotated(values, turn)
            code, aligned = codes(unit)
            batch["ints"] = packed(values)
            batch["code"] = packed(code)
            batch["aligned"] = aligned
            batch["norm"] = norm
            yield batch

    return rows


def integer_scores(rows: np.ndarray, anchor: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of integers; ``bound`` is no less than any of them."""
    if bound < 2.0**52:  # every partial sum is an integer that a double holds
        return np.rint(rows @ anchor).astype(np.int64)
    if bound < 2.0**62:
        return rows.astype(np.int64) @ anchor.astype(np.int64)
    raise OverflowError("a score is too large")


def first_rows(score: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id, those without an id last."""
    if len(score) > 4 * k:
        least = np.partition(score, -k)[-k]
        kept = np.nonzero(score >= least)[0]
        return kept[np.lexsort((ids[kept], none[kept], -score[kept]))[:k]]
    return np.lexsort((ids, none, -score))[:k]


class _Block:
    """The coded rows of a group as arrays."""

    def __init__(self, rows: pd.DataFrame, dims: int):
        self.ints = unpacked(rows["ints"], dims)
        self.code = unpacked(rows["code"], -(-dims // 64), np.uint64)
        self.aligned, self.norm = rows["aligned"].to_numpy(), rows["norm"].to_numpy()
        self.ids, self.none = rows["id"].to_numpy(), rows["none"].to_numpy()
        self.label = rows["label"].to_numpy()
        self.longest = self.norm.max() if len(rows) else 0.0


def _tiles(rows: pd.DataFrame, anchors: pd.DataFrame, dims: int) -> Iterator[tuple]:
    """For every anchor: its place, its integers, the rows, and the bounds of their scores."""
    block = _Block(rows, dims)
    values = unpacked(anchors["ints"], dims)
    unit, norm = rotated(values, rotation(dims))
    for begin in range(0, len(values) if len(rows) else 0, _TILE):
        part = slice(begin, begin + _TILE)
        low, high = intervals(unit[part], norm[part], block.code, block.aligned, block.norm)
        for i in range(len(low)):
            yield begin + i, values[begin + i], norm[begin + i] * block.longest, block, low[i], high[i]


def positive_finder(dims: int, k: int):
    """A function for cogroups: each anchor's k highest rows of its label in a block of rows."""

    def find(key: tuple, rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        uid, own, label = (anchors[c].to_numpy() for c in ("uid", "anchor_id", "label"))
        out = {"uid": [], "id": [], "none": [], "score": []}
        for at, anchor, bound, block, low, high in _tiles(rows, anchors, dims):
            there = np.nonzero((block.label == label[at]) & (block.none | (block.ids != own[at])))[0]
            if len(there) > k:
                there = there[high[there] >= np.partition(low[there], -k)[-k]]
            score = integer_scores(block.ints[there], anchor, bound)
            chosen = first_rows(score, block.none[there], block.ids[there], k)
            out["uid"] += [uid[at]] * len(chosen)
            out["id"] += block.ids[there[chosen]].tolist()
            out["none"] += block.none[there[chosen]].tolist()
            out["score"] += score[chosen].tolist()
        return pd.DataFrame(out)

    return find


def negative_finder(dims: int, k: int, band: tuple[int, int]):
    """A function for cogroups: for each anchor and positive the k highest rows in the band."""

    def find(key: tuple, rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        uid, label = anchors["uid"].to_numpy(), anchors["label"].to_numpy()
        out = {"uid": [], "place": [], "id": [], "none": [], "score": []}
        for at, anchor, bound, block, low, high in _tiles(rows, anchors, dims):
            positive = np.array(anchors["scores"].iloc[at], dtype=np.int64)
            whole, rest = np.divmod(positive, 100)  # so that hundredths fit a long
            least = band[0] * whole - (-band[0] * rest // 100)
            most = band[1] * whole + band[1] * rest // 100
            other = block.label != label[at]
            wanted = np.zeros(len(other), dtype=bool)
            for a, b in zip(least, most):
                inside = other & (high >= a) & (low <= b)
                sure = low[inside & (low >= a) & (high <= b)]
                if len(sure) >= k:
                    inside &= high >= np.partition(sure, -k)[-k]
                wanted |= inside
            there = np.nonzero(wanted)[0]
            score = integer_scores(block.ints[there], anchor, bound)
            for place, (a, b) in enumerate(zip(least, most)):
                held = np.nonzero((score >= a) & (score <= b))[0]
                met = there[held]
                chosen = first_rows(score[held], block.none[met], block.ids[met], k)
                out["uid"] += [uid[at]] * len(chosen)
                out["place"] += [place] * len(chosen)
                out["id"] += block.ids[met[chosen]].tolist()
                out["none"] += block.none[met[chosen]].tolist()
                out["score"] += score[held[chosen]].tolist()
        return pd.DataFrame(out)

    return find


def seventh_moved(key: Column, label: Column) -> Column:
    """The label, moved on by one of ten where 7 divides the key."""
    return F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)


def hard_negatives(
    table: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    every: int = 50,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    band: tuple[int, int] = BAND,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose key is divisible by ``every``. Components become integers,
    256 times the component rounded down; a score is the inner product of those. An anchor's
    positives are the highest other rows of its label, its negatives for a positive the
    highest rows of other labels with a score in ``band`` hundredths of the positive's.
    Higher scores come first, ties by the smaller key, null last.

    Rows are coded once: one bit for each component after a rotation, with alignment and
    length. Popcounts give an interval that holds an inner product for certain; rows whose
    interval rules them out are left, all others are scored exactly, so nothing is missed.
    Blocks of anchors meet blocks of rows, and each pair of blocks is a group of its own.

    A row takes no part whose label or vector is null, or whose vector has a null or
    non-finite component or another length than most, or none. A row's own rows are all with its key.
    Rows that repeat are rows each, but one anchor. Negative and zero positives have the
    band that the inequalities leave. Scores have to fit a long; others fail the job. An
    empty table gives no row. Other columns do not matter.
    """
    spark = table.sparkSession
    k, body = F.col(f"`{key}`").cast("bigint"), F.col(f"`{vector}`")
    named = label if label is not None else F.col("label")
    seen = table.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(k, F.lit(0)).alias("id"),
        k.isNull().alias("none"),
        named.cast("bigint").alias("label"),
        body.alias("v"),
    ).where(F.col("label").isNotNull() & is_finite(F.col("v")))
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    dims = usual_length(seen, F.col("v"))
    if not dims:
        return spark.createDataFrame([], result)
    coded = "row bigint, id bigint, none boolean, label bigint, ints binary, code binary, aligned double, norm double"
    rows = kept_table(seen.where(F.size("v") == dims).mapInPandas(coder(dims), coded), "codes")
    n_blocks = max(1, -(-rows.count() // ROWS))
    anchors = kept_table(
        rows.where(~F.col("none") & (F.col("id") % every == 0))
        .select("id", "label", "ints")
        .distinct()
        .select(F.xxhash64("id", "label", "ints").alias("uid"), F.col("id").alias("anchor_id"), "label", "ints"),
        "anchors",
    )
    n_parts = max(1, -(-anchors.count() // ANCHORS))

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = rows.withColumn("block", F.pmod("row", F.lit(n_blocks)).cast("int"))
    dealt = dealt.withColumn("part", blocks(n_parts)).drop("row").groupBy("block", "part")

    def meet(asked: DataFrame, find, kind: str) -> DataFrame:
        part = F.pmod(F.xxhash64("uid"), F.lit(n_parts)).cast("int")
        everywhere = asked.withColumn("part", part).withColumn("block", blocks(n_blocks))
        return dealt.cogroup(everywhere.groupBy("block", "part")).applyInPandas(find, kind)

    order = [F.desc("score"), "none", "id"]
    by_anchor = Window.partitionBy("uid").orderBy(*order)
    near = kept_table(
        meet(anchors, positive_finder(dims, positives), "uid bigint, id bigint, none boolean, score bigint")
        .withColumn("place", F.row_number().over(by_anchor) - 1)
        .where(F.col("place") < positives),
        "positives",
    )
    scores = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p"))
    asked = anchors.join(scores, "uid").select(
        "uid", "anchor_id", "label", "ints", F.transform("p", lambda x: x["score"]).alias("scores")
    )
    by_pair = Window.partitionBy("uid", "place").orderBy(*order)
    far = (
        meet(
            kept_table(asked, "anchors-asked"),
            negative_finder(dims, negatives, band),
            "uid bigint, place int, id bigint, none boolean, score bigint",
        )
        .withColumn("rank", F.row_number().over(by_pair))
        .where(F.col("rank") <= negatives)
    )

    def id_of(side: str) -> Column:
        return F.when(~F.col(f"{side}.none"), F.col(f"{side}.id"))

    return (
        far.alias("far")
        .join(near.alias("near"), ["uid", "place"])
        .join(anchors.select("uid", "anchor_id"), "uid")
        .select(
            "anchor_id",
            id_of("near").alias("positive_id"),
            "rank",
            id_of("far").alias("negative_id"),
            F.col("near.score").alias("positive_score"),
            F.col("far.score").alias("negative_score"),
        )
    )
