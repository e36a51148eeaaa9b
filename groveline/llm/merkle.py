"""Merkle manifest: a content-addressed tree per source, and the proof of every row."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groveline.llm.columns import kept_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
# Levels that one record holds: the digest of a node, and its descendants level by level.
LEVELS = 4

_RECORD = (
    "g string, page bigint, size bigint, digest string, steps int, more boolean, "
    "l0 array<string>, l1 array<string>, l2 array<string>, l3 array<string>, "
    "a array<string>, b array<string>"
)
_RESULT = "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def parents(nodes: Sequence[str]) -> list[str]:
    """The digests of runs of consecutive nodes, the last of which may be shorter."""
    return [digest("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]


def depth(size: int) -> int:
    """Levels above ``size`` leaves until one node remains."""
    levels = 0
    while FANOUT**levels < size:
        levels += 1
    return levels


def record_maker(number: int):
    """A function for mapInPandas: completes the records of one round of building."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for size, leaves in zip(batch["size"], batch["l0"]):
                above = max(0, depth(int(size)) - LEVELS * number)
                steps = min(LEVELS, above)
                levels = [list(leaves)]
                for _ in range(steps):
                    levels.append(parents(levels[-1]))
                inner = [*levels[1:steps], [], [], []][: LEVELS - 1]
                made.append((levels[-1][0], steps, above > LEVELS, *inner))
            names = ["digest", "steps", "more", "l1", "l2", "l3"]
            table = pd.DataFrame(made, columns=names, index=batch.index)
            yield pd.concat([batch, table], axis=1)

    return rows


def segments(levels: list[Sequence[str]], steps: int, rank: int) -> list[str]:
    """The children that are not selected on the way from a record's digest to one leaf.

    Each digit of the rank selects a child, the highest digit first. A segment is what
    stands before the selected child, a slash, and what stands after it.
    """
    found = []
    for j in reversed(range(steps)):
        node = rank // FANOUT**j
        digit = node % FANOUT
        run = levels[j][node - digit : node - digit + FANOUT]
        found.append("".join(run[:digit]) + "/" + "".join(run[digit + 1 :]))
    return found


def _descents(batch: pd.DataFrame) -> Iterator[tuple]:
    columns = ("path", "steps", "subroot", "l0", "l1", "l2", "l3", "a", "b")
    for path, steps, subroot, *levels, a, b in zip(*[batch[c] for c in columns]):
        for rank, child in enumerate(levels[0]):
            yield [*path, *segments(levels, steps, rank)], subroot, child, a[rank], b[rank]


def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: requests go on from the digest of a record to each of its leaves."""
    for batch in batches:
        moved = [(child, path, subroot, a) for path, subroot, child, a, _ in _descents(batch)]
        yield pd.DataFrame(moved, columns=["digest", "path", "subroot", "a"])


def arrive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: requests reach the leaves, and their paths are reversed and folded."""
    for batch in batches:
        found = []
        for path, subroot, leaf, key, changed in _descents(batch):
            proof, folded = [], changed
            for segment in reversed(path):
                before, after = segment.split("/")
                proof += (before, after)
                folded = digest(before + folded + after)
            found.append((key, leaf, subroot, digest("".join(proof)), folded))
        yield pd.DataFrame(found, columns=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each a minus if null, else its bytes in UTF-8 with their count."""

    def part(field: Column) -> Column:
        text = field.cast("string")
        told = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        return F.when(text.isNull(), F.lit("-")).otherwise(told)

    return F.sha2(F.concat(*[part(f) for f in fields]).cast("binary"), 256)


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """``rank`` of every node in its group ``g`` by ``order``, and ``size`` of the group.

    One sort by range places the nodes; a hot group spans many partitions, and repeated
    nodes are told apart by a row number. The rank is the place in the partition plus the
    group's nodes in the partitions before, of which there is one count for each group
    and partition.
    """
    by = ["g", *order, "__row"]
    spread = nodes.withColumn("__row", F.monotonically_increasing_id())
    placed = kept_table(
        spread.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("__row")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33)),
        "placed-nodes",
    )
    pieces = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = Window.partitionBy("g")
    before = F.sum("n").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = kept_table(
        pieces.select(
            "g", "part", "first",
            F.coalesce(before, F.lit(0)).alias("before"),
            F.sum("n").over(parts).alias("size"),
        ),
        "places-of-groups",
    )
    rank = F.col("before") + F.col("at") - F.col("first")
    return placed.join(starts, ["g", "part"]).withColumn("rank", rank).drop("at", "part", "first", "before")


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Records of the trees over ``nodes`` (g, rank, size, digest, a, b), and their roots.

    A round groups the nodes by the next four digits of their rank and writes one record
    (digest -> descendants) for each group, of 81 nodes at most. The roots are (g, digest,
    round): in which round's records a root stands.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 0
    width = FANOUT**LEVELS
    rounds: list[DataFrame] = []
    while True:
        number = len(rounds)
        runs = nodes.groupBy("g", F.floor(F.col("rank") / width).alias("page")).agg(
            F.first("size").alias("size"),
            F.array_sort(F.collect_list(F.struct("rank", "digest", "a", "b"))).alias("run"),
        )
        listed = runs.select(
            "g", "page", "size",
            F.transform("run", lambda x: x["digest"]).alias("l0"),
            F.transform("run", lambda x: x["a"]).alias("a"),
            F.transform("run", lambda x: x["b"]).alias("b"),
        )
        made = kept_table(listed.mapInPandas(record_maker(number), _RECORD), f"records-{number}")
        rounds.append(made)
        if width ** len(rounds) >= largest:
            break
        nothing = F.lit(None).cast("string")
        nodes = made.where("more").select(
            "g", F.col("page").alias("rank"), "size", "digest", nothing.alias("a"), nothing.alias("b")
        )
    roots = [
        made.where("NOT more").select("g", "digest", F.lit(number).alias("round"))
        for number, made in enumerate(rounds)
    ]
    found = roots[0]
    for more in roots[1:]:
        found = found.unionAll(more)
    return rounds, found


def _reach(asked: DataFrame, records: DataFrame) -> DataFrame:
    """Requests (digest, path, subroot) beside the record of their digest.

    Equal digests have equal records, of which one is kept.
    """
    distinct = kept_table(
        records.select("digest", "steps", "l0", "l1", "l2", "l3", "a", "b").dropDuplicates(["digest"]),
        "records-by-digest",
    )
    return asked.join(distinct, "digest")


def manifest(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    group: str = "source",
    fields: Sequence[str] = FIELDS,
    text: str = "text",
    tampered: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row.

    A row's digest is its leaf. The leaves of a source, by key, are joined in runs of three
    until one node, the subroot, is left; the subroots, by source, give the root in the
    same way. Records map a digest to its descendants. Requests for all leaves descend
    from the root: the digits of a leaf's rank select the children, those not selected are
    collected, and requests whose digits agree so far travel as one. The reversed path is
    the proof; folding it with the leaf must give the root again. ``tampered(key, text)``
    says what text the folded leaf has; without it that is the original.

    Null sources and keys come first, rows with equal keys are ordered by their leaves,
    and repeated rows are leaves of their own. Null and empty texts differ. The one leaf
    of a source is its subroot, and a single subroot is the root. An empty table
    gives no row. Other columns do not matter.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[key].dataType
    k, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    leaf = leaf_digest([F.col(f"`{f}`") for f in fields])
    changed = leaf
    if tampered is not None:
        other = tampered(k, body)
        again = leaf_digest([other if f == text else F.col(f"`{f}`") for f in fields])
        changed = F.when(other.eqNullSafe(body), leaf).otherwise(again)
    of_group = F.col(f"`{group}`").cast("string")
    leaves = kept_table(
        docs.select(
            # the empty string sorts first and stands for null
            F.coalesce(F.concat(F.lit("="), of_group), F.lit("")).alias("g"),
            k.alias("k"),
            leaf.alias("digest"),
            changed.alias("b"),
        ),
        "leaves",
    )
    nodes = ranked(leaves, "k", "digest").withColumn("a", F.col("k").cast("string")).drop("k")
    records, subroots = build(nodes)
    tops = subroots.select(
        F.lit("").alias("g"), F.col("g").alias("k"), "digest", F.col("round").cast("string").alias("a")
    )
    upper, root = build(ranked(tops, "k").drop("k").withColumn("b", F.col("a")))
    found = root.select("digest").first()
    result = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if found is None:
        return spark.createDataFrame([], result.format(kind.simpleString()))

    step = "digest string, path array<string>, subroot string, a string"
    asked = spark.createDataFrame(
        [(found.digest, [], None)], "digest string, path array<string>, subroot string"
    )
    for made in reversed(upper):
        asked = kept_table(_reach(asked, made).mapInPandas(descend, step), "requests")
    # what the upper tree selects last are the subroots, and where their records stand
    asked = asked.select("digest", "path", F.col("digest").alias("subroot"), F.col("a").cast("int").alias("round"))
    for number in range(len(records) - 1, 0, -1):
        reached = _reach(asked.where(F.col("round") == number).drop("round"), records[number])
        moved = reached.mapInPandas(descend, step).select(
            "digest", "path", "subroot", F.lit(number - 1).alias("round")
        )
        asked = kept_table(asked.where(F.col("round") < number).unionAll(moved), "requests")
    arrived = _reach(asked.drop("round"), records[0]).mapInPandas(arrive, _RESULT)
    whole = F.lit(found.digest)
    return arrived.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        "leaf",
        "subroot",
        whole.alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == whole).alias("verified"),
    )


def line_breaks_deleted(key: Column, text: Column) -> Column:
    """The text without line breaks where 2 divides the CRC-32 of the decimal key."""
    marked = F.crc32(key.cast("string").cast("binary")) % 2 == 0
    return F.when(marked, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
