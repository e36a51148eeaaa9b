"""Approximate nearest neighbours: an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveline.llm.columns import kept_table
from groveline.llm.vectors import is_finite, matrix, packed, unpacked, usual_length

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEAREST = 10
# The bound of the sample on which centroids are fitted, in rows and in bytes.
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 64 << 20
# Rows per cell aimed at, and the most centroids of a half; cells are pairs of centroids.
PER_CELL = 64
MOST_CENTROIDS = 256
# Rows of the sample that are searched exactly to find how far a search must go, and the
# share of their neighbours that it must reach.
PROBES = 128
REACHED = 0.97
# A search visits no fewer entries than these, where there are so many.
LEAST_VISITED = 4096
# Entries and queries that meet in one task at once.
ENTRIES = 2048
QUERIES = 2048
_ROUNDS = 12


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, fast and nearly exact."""
    found = -2.0 * points @ centres.T
    found += (points * points).sum(axis=1)[:, None]
    found += (centres * centres).sum(axis=1)
    return np.maximum(found, 0.0, out=found)


def exact(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added from first to last."""
    total = np.zeros(len(points))
    for j in range(points.shape[1]):
        total += (points[:, j] - query[j]) ** 2
    return np.sqrt(total)


def centroids(points: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k-means, begun at rows that lie far from those chosen before."""
    draw = np.random.default_rng(seed)
    centres = points[draw.integers(len(points))][None, :]
    nearest = squared(points, centres)[:, 0]
    while len(centres) < k and nearest.sum() > 0:
        chosen = points[draw.choice(len(points), p=nearest / nearest.sum())][None, :]
        centres = np.vstack([centres, chosen])
        nearest = np.minimum(nearest, squared(points, chosen)[:, 0])
    for _ in range(_ROUNDS):
        own = squared(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        counts = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


@dataclass
class Quantiser:
    """Centroids of either half. A cell is a pair of them."""

    first: np.ndarray
    second: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return squared(points[:, :half], self.first), squared(points[:, half:], self.second)

    def cell(self, points: np.ndarray) -> np.ndarray:
        a, b = self.distances(points)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)


def traverse(a: np.ndarray, b: np.ndarray) -> Iterator[int]:
    """Cells by the sum of the distances to their two centroids, nearest first.

    A heap holds the pairs whose predecessors in either order have been visited.
    """
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap = [(a[by_a[0]] + b[by_b[0]], 0, 0)]
    reach = np.full(len(a), -1)  # how far the second order has been visited, for each of the first
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(by_a[i]) * len(b) + int(by_b[j])
        reach[i] = j
        if i + 1 < len(a) and reach[i + 1] == j - 1:
            heapq.heappush(heap, (a[by_a[i + 1]] + b[by_b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or reach[i - 1] > j):
            heapq.heappush(heap, (a[by_a[i]] + b[by_b[j + 1]], i, j + 1))


def indexer(quantiser: Quantiser, dims: int):
    """A function for mapInPandas: the cell of every vector, and the vector in bytes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = matrix(batch.pop("v"), dims)
            batch["cell"] = quantiser.cell(points).astype(np.int32)
            batch["v"] = packed(points)
            yield batch

    return rows


def _least(score: np.ndarray, none: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, none, score))[:k]


def prober(probes: np.ndarray, ids: np.ndarray, dims: int, k: int):
    """A function for mapInPandas: the cells of the k entries of a task nearest to each probe."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.empty(0), np.empty(0, dtype=np.int32))] * len(probes)
        for batch in batches:
            points = unpacked(batch["v"], dims)
            cells = batch["cell"].to_numpy()
            entry, none = batch["id"].to_numpy(), batch["none"].to_numpy()
            apart = squared(probes, points)
            for i in range(len(probes)):
                apart[i, (entry == ids[i]) & ~none] = np.inf
                score = np.concatenate([best[i][0], apart[i]])
                near = np.argsort(score, kind="stable")[:k]
                best[i] = score[near], np.concatenate([best[i][1], cells])[near]
        for i, (score, cell) in enumerate(best):
            there = np.isfinite(score)
            yield pd.DataFrame({"probe": i, "score": score[there], "cell": cell[there]})

    return rows


def visitor(quantiser: Quantiser, counts: np.ndarray, start: np.ndarray, chunks: np.ndarray, visit: int, dims: int):
    """A function for mapInPandas: the buckets that queries visit, with the cells asked for there."""

    def visited(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found, met = [], 0
        for cell in traverse(a, b):
            if met >= visit:
                break
            if counts[cell]:
                found.append(cell)
                met += counts[cell]
        return np.array(found, dtype=np.int64)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first, second = quantiser.distances(unpacked(batch["v"], dims))
            for i in range(len(batch)):
                cells = visited(first[i], second[i])
                each = np.repeat(cells, chunks[cells])
                ends = np.cumsum(chunks[cells])
                bucket = start[each] + np.arange(len(each)) - np.repeat(ends - chunks[cells], chunks[cells])
                order = np.argsort(bucket, kind="stable")
                bucket, each = bucket[order], each[order]
                at, begin = np.unique(bucket, return_index=True)
                yield pd.DataFrame(
                    {
                        "q": batch["q"].iloc[i],
                        "query_id": batch["query_id"].iloc[i],
                        "v": batch["v"].iloc[i],
                        "bucket": at,
                        "cells": np.split(each.astype(np.int32), begin[1:]),
                    }
                )

    return rows


def reranker(dims: int, k: int, tile: int = 128):
    """A function for cogroups: the exact nearest of a bucket's entries in the cells asked for."""

    def nearest(key: tuple, entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        points = unpacked(entries["v"], dims)
        ids, none = entries["id"].to_numpy(), entries["none"].to_numpy()
        cells, place = np.unique(entries["cell"].to_numpy(), return_inverse=True)
        queries, own = unpacked(asked["v"], dims), asked["query_id"].to_numpy()
        norms = (points * points).sum(axis=1)
        out = {"q": [], "query_id": [], "id": [], "none": [], "score": []}
        for begin in range(0, len(queries) if len(points) else 0, tile):
            part = queries[begin : begin + tile]
            apart = squared(part, points)
            for i, query in enumerate(part):
                wanted = np.isin(cells, asked["cells"].iloc[begin + i])[place]
                there = np.nonzero(wanted & (none | (ids != own[begin + i])))[0]
                if len(there) > k:
                    # the fast distances leave out only what their error cannot bring back
                    near = apart[i, there]
                    error = 1e-9 * (norms[there].max() + query @ query)
                    there = there[near <= np.partition(near, k - 1)[k - 1] + error]
                score = exact(points[there], query)
                chosen = _least(score, none[there], ids[there], k)
                there = there[chosen]
                out["q"] += [asked["q"].iloc[begin + i]] * len(there)
                out["query_id"] += [own[begin + i]] * len(there)
                out["id"] += ids[there].tolist()
                out["none"] += none[there].tolist()
                out["score"] += score[chosen].tolist()
        return pd.DataFrame(out)

    return nearest


@dataclass
class Index:
    """All valid rows by cell, how many each cell has, and how many a search visits."""

    dims: int
    quantiser: Quantiser
    entries: DataFrame
    counts: np.ndarray
    visit: int


def _numbered(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(row, id, none, v) of the rows that can be compared."""
    body = F.col(f"`{vector}`")
    seen = table.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0)).alias("id"),
        F.col(f"`{key}`").isNull().alias("none"),
        body.alias("v"),
    )
    return seen.where(is_finite(F.col("v")) & F.exists("v", lambda x: x != 0))


def build_index(
    table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST
) -> Index | None:
    """Fit the quantiser on a bounded sample, index every row, and find how far to search.

    The sample has about ``SAMPLE_ROWS`` rows, fewer if they would take more than
    ``SAMPLE_BYTES``. ``PROBES`` of them are compared with all rows; a search then visits
    so many entries that ``REACHED`` of the probes' neighbours would have been met, and
    ``LEAST_VISITED`` at least.
    """
    rows = _numbered(table, key, vector)
    dims = usual_length(rows, F.col("v"))
    if not dims:
        return None
    rows = rows.where(F.size("v") == dims)
    n = rows.count()
    most = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
    drawn = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.lit(int(min(1.0, most / n) * (1 << 30)))
    sample = rows.where(drawn).select("id", "none", "v").limit(2 * most).toPandas()
    if not len(sample):
        sample = rows.limit(1).select("id", "none", "v").toPandas()
    points = matrix(sample["v"], dims)
    half, k = max(1, dims // 2), max(1, min(MOST_CENTROIDS, round((n / PER_CELL) ** 0.5)))
    halves = points[:, :half], points[:, half:] if dims > 1 else np.zeros((len(points), 1))
    if dims == 1:  # nothing is left for the second half
        quantiser = Quantiser(centroids(halves[0], k), np.zeros((1, 0)))
    else:
        quantiser = Quantiser(centroids(halves[0], k), centroids(halves[1], k))
    entries = kept_table(
        rows.mapInPandas(indexer(quantiser, dims), "row bigint, id bigint, none boolean, cell int, v binary"),
        "index",
    )
    counts = np.zeros(quantiser.cells, dtype=np.int64)
    for cell, met in entries.groupBy("cell").agg(F.count(F.lit(1))).collect():
        counts[cell] = met

    probes = points[:PROBES]
    ids = np.where(sample["none"][:PROBES], -1, sample["id"][:PROBES])
    by_probe = Window.partitionBy("probe").orderBy("score")
    close = (
        entries.mapInPandas(prober(probes, ids, dims, nearest), "probe int, score double, cell int")
        .withColumn("rank", F.row_number().over(by_probe))
        .where(F.col("rank") <= nearest)
        .select("probe", "cell")
        .collect()
    )
    first, second = quantiser.distances(probes)
    need = []
    for i in range(len(probes)):
        total = (first[i][:, None] + second[i][None, :]).ravel()
        order = np.argsort(total, kind="stable")
        before = np.empty(len(order), dtype=np.int64)
        before[order] = np.cumsum(counts[order]) - counts[order]
        need += [before[c] for p, c in close if p == i]
    reach = int(np.quantile(need, REACHED, method="higher")) if need else 0
    return Index(dims, quantiser, entries, counts, max(LEAST_VISITED, reach + nearest + 1))


def search(index: Index, queries: DataFrame, *, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` (query_id, v), v of doubles in bytes.

    A query's entries are those of the cells it visits, in the order of the summed
    distances to their centroids, until ``index.visit`` entries are met.

    Cells are dealt into buckets of at most ``ENTRIES`` entries; a larger cell gets
    several. Where more than ``QUERIES`` queries visit a bucket they come in blocks.
    A task holds one bucket and one block.
    """
    spark = queries.sparkSession
    counts = index.counts
    chunks = np.maximum(1, -(-counts // ENTRIES))
    start, bucket, room = np.zeros(len(counts), dtype=np.int64), -1, 0
    for cell, n in enumerate(counts.tolist()):
        if chunks[cell] > 1:
            start[cell], bucket, room = bucket + 1, bucket + int(chunks[cell]), 0
        else:
            if n > room:
                bucket, room = bucket + 1, ENTRIES
            start[cell], room = max(bucket, 0), room - n
    visits = kept_table(
        queries.mapInPandas(
            visitor(index.quantiser, counts, start, chunks, index.visit, index.dims),
            "q bigint, query_id bigint, v binary, bucket bigint, cells array<int>",
        ),
        "visits",
    )
    blocks = kept_table(
        visits.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks")),
        "blocks",
    )
    asked = visits.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int"))
    # no more rows than there are cells
    met = [(c, int(start[c]), int(chunks[c])) for c in np.nonzero(counts)[0].tolist()]
    places = F.broadcast(spark.createDataFrame(met, "cell int, start bigint, chunks int"))
    entries = (
        index.entries.join(places, "cell")
        .withColumn("bucket", F.col("start") + F.pmod("row", "chunks"))
        .join(blocks, "bucket")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "block", "id", "none", "cell", "v")
    )
    found = (
        entries.groupBy("bucket", "block")
        .cogroup(asked.select("bucket", "block", "q", "query_id", "v", "cells").groupBy("bucket", "block"))
        .applyInPandas(
            reranker(index.dims, nearest), "q bigint, query_id bigint, id bigint, none boolean, score double"
        )
    )
    best = Window.partitionBy("q").orderBy("score", "none", "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", F.when(~F.col("none"), F.col("id")).alias("vec_id"), "score")
    )


def nearest_neighbours(
    table: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    nearest: int = NEAREST,
    every: int = 100,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the nearest other rows found.

    Queries are the rows whose key is divisible by ``every``. Distances are Euclidean, of
    the original vectors in double precision; ties go to the smaller key, null last.

    A vector that is null or zero, or has a null or non-finite component or another length
    than most, takes no part. A row's own rows are all with its key. Rows that repeat are
    candidates each, but as queries one. A query without other rows has no result, and an
    empty table gives no row. Other columns do not matter.
    """
    index = build_index(table, key=key, vector=vector, nearest=nearest)
    if index is None:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    queries = (
        index.entries.where(~F.col("none") & (F.col("id") % every == 0))
        .select("id", "v")
        .distinct()
        .select(F.xxhash64("id", "v").alias("q"), F.col("id").alias("query_id"), "v")
    )
    return search(index, queries, nearest=nearest)
