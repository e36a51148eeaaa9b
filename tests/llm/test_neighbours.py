import numpy as np
import pytest
from pyspark.sql import functions as F

from groveline.llm import neighbours, queries


def brute(rows, nearest=10, every=100):
    """(query, rank, other, score) by comparing everything with everything."""
    usable = [
        (k, np.array(v, dtype=np.float64))
        for k, v in rows
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    lengths = [len(v) for _, v in usable]
    usual = max(sorted(set(lengths)), key=lengths.count, default=0)
    usable = [(k, v) for k, v in usable if len(v) == usual]
    out = set()
    for k, q in usable:
        if k is not None and k % every == 0:
            apart = sorted(
                (float(np.sqrt(np.cumsum((v - q) ** 2)[-1])), o is None, o or 0) for o, v in usable if o != k
            )
            out |= {
                (k, i + 1, None if none else o, s, q.tobytes()) for i, (s, none, o) in enumerate(apart[:nearest])
            }
    return sorted((x[:4] for x in out), key=repr)


def collected(table, **options):
    return sorted((tuple(r) for r in neighbours.nearest_neighbours(table, **options).collect()), key=repr)


def recall(found, true):
    """The share of true neighbours found, ties at the last rank included."""
    last = {}
    for q, _, _, s in true:
        last[q] = max(last.get(q, 0.0), s)
    return sum(s <= last[q] for q, _, _, s in found) / len(true)


def test_small_tables_are_searched_whole(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    assert collected(table) == brute(rows)


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_a_partial_search(spark, monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "LEAST_VISITED", 0)
    monkeypatch.setattr(neighbours, "ENTRIES", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    draw = np.random.default_rng(3)
    points = draw.standard_normal((4000, 16))
    if clustered:
        points = points * 0.2 + 3 * draw.standard_normal((40, 16))[draw.integers(40, size=4000)]
    points[1500:2800] = points[1500]  # a third of all rows are one vector
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    index = neighbours.build_index(table)
    assert index.counts.sum() == len(rows) and index.counts.max() > 3 * neighbours.ENTRIES
    assert not clustered or index.visit < 3000
    found, true = collected(table), brute(rows)
    assert len(found) == len(true)
    assert recall(found, true) >= 0.9


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [5.0, 1.0]), (3, [1.0, 2.0]), (2, [1.0, 2.0]),
        (None, [1.0, 2.0]), (None, [0.5, 0.5]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (9, [None, 1.0]), (200, [1.0, 2.0, 3.0]), (300, [0.0, 0.0]), (-100, [1e8, -1e8]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    clashing = table.withColumns({c: F.lit(f"extra {c}") for c in "row id none v q cell bucket block cells score rank".split()})
    assert collected(clashing) == brute(rows)
    assert collected(table.limit(0)) == []
    assert collected(table.where("vec_id = 6")) == []
    assert collected(table.where("vec_id = 0").limit(1)) == []
    single = spark.createDataFrame([(i, [float(i)]) for i in range(1, 150)], "vec_id bigint, embedding array<float>")
    assert [r[2] for r in sorted(collected(single))] == [99, 101, 98, 102, 97, 103, 96, 104, 95, 105]


def test_cells_come_by_the_sum_of_their_distances():
    draw = np.random.default_rng(1)
    a, b = draw.random(7), draw.random(5)
    visited = list(neighbours.traverse(a, b))
    assert sorted(visited) == list(range(35))
    sums = [a[c // 5] + b[c % 5] for c in visited]
    assert sums == sorted(sums)


def test_the_query_ranks_every_query(spark, small):
    rows = queries.op12_nearest_neighbours(spark, small).collect()
    assert sorted((r["query_id"], r["rank"]) for r in rows) == [(q, k) for q in range(0, 500, 100) for k in range(1, 11)]
