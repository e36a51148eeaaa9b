import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from groveline.llm import sharding


def check_law(docs, **options):
    rows = sharding.shard(docs, **options).collect()
    given = Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))
        for r in docs.select("doc_id", "text").collect()
    )
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == given
    shards = defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        shards[r["shard"]].append(r)
    for held in shards.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    return shards, rows


def spread(shards, rows):
    sizes = [sum(r["size"] for r in shards.get(s, [])) for s in range(16)]
    return max(abs(s - sum(sizes) / 16) for s in sizes), max(r["size"] for r in rows)


def test_shards_are_near_equal(corpus):
    shards, rows = check_law(corpus)
    off, largest = spread(shards, rows)
    assert off <= largest


def test_small_parts_keep_slots_gapless(corpus):
    shards, rows = check_law(corpus, rows_per_part=7)
    off, largest = spread(shards, rows)
    assert off <= largest


def test_tolerance_holds_where_rows_are_small(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    shards, rows = check_law(docs, rows_per_part=3000)
    mean = sum(r["size"] for r in rows) / 16
    assert spread(shards, rows)[0] <= 2 * sharding.TOLERANCE * mean + 6


@pytest.mark.parametrize("one_key", [False, True])
def test_hot_text_is_split(spark, one_key):
    docs = spark.range(6000).select(
        F.when(F.lit(one_key), F.lit(1)).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("a hot text").alias("text"),
    )
    shards, rows = check_law(docs, rows_per_part=500)
    mean = sum(r["size"] for r in rows) / 16
    assert spread(shards, rows)[0] <= 2 * sharding.TOLERANCE * mean + 12


def test_equal_texts_stay_together_where_they_can(spark):
    docs = spark.range(8000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.floor(F.col("id") / 2)).alias("text")
    )
    homes = defaultdict(set)
    for r in sharding.shard(docs).join(docs, "doc_id").collect():
        homes[r["text"]].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())


def test_edges(edge, empty, edge_rows):
    _, rows = check_law(edge)
    assert len(rows) == len(edge_rows)
    assert sharding.shard(empty).collect() == []
    check_law(edge.limit(1))


def test_rows_arrive_whole_in_their_shards(edge):
    rows = sharding.deal(edge, rows_per_part=2).collect()
    assert Counter(tuple(r["row"]) for r in rows) == Counter(map(tuple, edge.collect()))
    assert rows[0]["row"].asDict().keys() == edge.first().asDict().keys()


def test_parts_and_what_the_driver_holds_are_bounded(spark, monkeypatch):
    """Far more rows than parts: the targets, and so the counts that come to the driver, stay few."""
    seen = []
    found = sharding.splitters
    monkeypatch.setattr(sharding, "splitters", lambda keys, targets: seen.append(len(targets)) or found(keys, targets))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    check_law(docs, rows_per_part=10, most_parts=40)
    assert seen == [15 + 39]
