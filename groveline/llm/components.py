"""Connected components of an undirected graph, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm.columns import kept_table


# At most this many nodes count as hot, whatever the size of the graph.
_MOST_HOT = 1000


def with_least(ends: DataFrame, least: DataFrame, n_ends: int) -> DataFrame:
    """``ends`` (u, v) with ``m``, given for each u in ``least`` (u, m, n).

    ``n`` is the number of ends at u and ``n_ends`` no less than their total. A node with
    more than one end in ``_MOST_HOT`` is hot: there are fewer than ``_MOST_HOT`` such
    nodes, so theirs are broadcast and their ends stay where they are. All other ends are
    shuffled, and no node brings more than that share of them to one task.
    """
    is_hot = F.col("n") * _MOST_HOT > n_ends
    hot = least.where(is_hot).select("u", F.col("m").alias("hot_m"))
    others = least.where(~is_hot).select("u", "m")
    marked = ends.join(F.broadcast(hot), "u", "left")
    stay = marked.where("hot_m IS NOT NULL").select("u", "v", F.col("hot_m").alias("m"))
    move = marked.where("hot_m IS NULL").select("u", "v").join(others, "u")
    return stay.unionAll(move)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    return (
        with_least(both.where(F.col("v") > F.col("u")), least, 2 * n)
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Tie the smaller neighbours of a node, and the node, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    tied = (
        with_least(edges, least, n)
        .where(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return tied.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), root the smallest node it can reach.

    Alternating star operations: each round ties nodes to smaller ones until every node
    hangs on its root. The number of rounds grows with the logarithm of the longest path.
    A node with many neighbours is not gathered anywhere: its minimum is a partial
    aggregate, which comes to its edges by broadcast. Each half of a round is written to
    the shared folder, so nothing is computed twice and lost executors cost one half at
    most.

    Loops do not matter; a node met in loops only is its own root.
    """
    nodes = kept_table(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    loops = nodes.where("u = v").select("u").distinct()
    links = nodes.where("u <> v")
    n, seen = links.count(), None
    while True:
        # the first half hands on one row per edge at most, so ``n`` bounds both
        large = kept_table(_large_star(links, n), "large-star")
        links = kept_table(_small_star(large, n).distinct(), "star")
        state = links.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark"),
        ).first()
        if state == seen:
            break
        n, seen = state.n, state
    rooted = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = rooted.unionAll(roots)
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("root")).join(
        found.select("node"), "node", "left_anti"
    )
    return found.unionAll(alone)
