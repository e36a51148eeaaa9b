import math

import numpy as np
from pyspark.sql import functions as F

from groveline.llm import negatives, queries


def brute(rows, every=50):
    usable = [
        (k, (label + 1) % 10 if k is not None and k % 7 == 0 else label, [math.floor(256 * x) for x in v])
        for k, label, v in rows
        if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    lengths = [len(v) for *_, v in usable]
    usual = max(sorted(set(lengths)), key=lengths.count, default=0)
    usable = [r for r in usable if len(r[2]) == usual]
    out, asked = [], []
    for anchor in usable:
        k, label, v = anchor
        if k is None or k % every or anchor in asked:
            continue
        asked.append(anchor)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), o is None, o or 0, m) for o, m, w in usable if o != k)
        for score, none, o, _ in [s for s in scored if s[3] == label][:5]:
            held = [s for s in scored if s[3] != label and 50 * -score <= 100 * -s[0] <= 95 * -score]
            for rank, other in enumerate(held[:3], 1):
                out.append((k, None if none else o, rank, None if other[1] else other[2], -score, -other[0]))
    return sorted(out, key=repr)


def collected(table):
    label = negatives.seventh_moved(F.col("vec_id"), F.col("label"))
    return sorted((tuple(r) for r in negatives.hard_negatives(table, label=label).collect()), key=repr)


def rows_of(table):
    return [(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()]


def test_equals_plain_python(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    found = collected(table)
    assert found == brute(rows_of(table)) and found
    assert sorted(map(tuple, queries.op13_hard_negatives(spark, small).collect()), key=repr) == found


def test_many_blocks_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    draw = np.random.default_rng(5)
    points = draw.integers(-2, 3, (600, 3)) / 2  # few values, so many ties
    points[200:400] = points[200]
    rows = [(i, int(draw.integers(4)), p.tolist()) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(4)
    assert collected(table) == brute(rows)


def test_edges(spark):
    nan = float("nan")
    rows = [
        (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (50, 1, [-1.0, -2.0]), (50, 2, [3.0, 1.0]), (1, 1, [1.0, 1.5]),
        (2, 2, [0.9, 1.0]), (3, 2, [0.9, 1.0]), (None, 2, [0.9, 1.0]), (None, 1, [2.0, 2.0]), (4, None, [1.0, 1.0]),
        (5, 1, None), (6, 1, []), (100, 1, [nan, 1.0]), (8, 2, [None, 1.0]), (150, 3, [0.0, 0.0]), (9, 3, [0.0, 0.0]),
        (10, 3, [float("inf"), 0.0]), (200, 1, [1.0, 1.0, 1.0]), (7, 9, [0.6, 1.1]), (250, 0, [1e6, 1.0]), (14, 8, [0.5, 0.5]),
    ]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    clashing = table.withColumns({c: F.lit(f"extra {c}") for c in "row id none v ints code norm uid place block part".split()})
    assert collected(clashing) == brute(rows)
    assert collected(table.limit(0)) == []
    assert collected(table.where("label IS NULL")) == []


def test_intervals_hold_every_inner_product():
    draw = np.random.default_rng(2)
    for dims in (1, 3, 64, 100):
        turn = negatives.rotation(dims)
        assert np.allclose(turn @ turn.T, np.eye(dims))
        values = np.floor(256 * draw.standard_normal((60, dims)))
        values[0] = 0
        values[1] = values[2]
        unit, norm = negatives.rotated(values, turn)
        code, aligned = negatives.codes(unit)
        low, high = negatives.intervals(unit[:20], norm[:20], code, aligned, norm)
        true = values[:20] @ values.T
        assert (low <= true).all() and (true <= high).all()
        if dims == 64:  # and they are no wider than their lengths allow
            assert (high - low).mean() < 1.5 * np.outer(norm[:20], norm).mean()
