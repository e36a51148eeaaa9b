import random
import re

import numpy as np
import pytest
import xxhash

from groveline.llm import components, kernels, simhash


def brute_fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Groups:
    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def brute(rows, radius=4):
    prints = [brute_fingerprint(t) for _, t in rows]
    groups = Groups(len(rows))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                groups.join(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            at = groups.root(i)
            least[at] = min(key, least.get(at, key))
    return [(k, f"{prints[i]:016x}", least.get(groups.root(i))) for i, (k, _) in enumerate(rows)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_equals_plain_python(corpus, edge):
    for docs in (corpus.select("doc_id", "text"), edge):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
        assert ordered(got) == ordered(brute(rows))


def test_small_tiles_and_chunks_change_nothing(corpus, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    monkeypatch.setattr(simhash, "_BUCKET", 32)
    monkeypatch.setattr(simhash, "_CHUNK", 20)
    got = [tuple(r) for r in simhash.near_duplicates(corpus).collect()]
    assert ordered(got) == ordered(brute(rows))


def test_keep_first_keeps_one_row_of_each_component(edge, empty):
    kept = simhash.keep_first(edge).collect()
    found = {(r["component_id"], r["fingerprint"]) for r in simhash.near_duplicates(edge).collect()}
    components_ = {}
    for component, fingerprint in found:
        components_.setdefault(component, set()).add(fingerprint)
    assert sorted(r["doc_id"] for r in kept) == sorted(components_)
    assert all(r["row"] == "extra row" for r in kept)
    assert simhash.keep_first(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []


def test_rows_without_any_key_keep_one_of_each_text(spark):
    text = "some words that are long enough to be told apart from the others"
    docs = spark.createDataFrame(
        [(None, text), (None, text), (None, text[::-1])], "doc_id bigint, text string"
    )
    assert sorted(r["text"] for r in simhash.keep_first(docs).collect()) == sorted([text, text[::-1]])


def test_close_pairs_equal_all_pairs():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 2**63, 300, dtype=np.uint64)
    values = np.concatenate([values, values[:100] ^ np.uint64(0b10101), values[:50] ^ np.uint64(1)])
    want = {
        (i, j)
        for i in range(len(values))
        for j in range(len(values))
        if (int(values[i]) ^ int(values[j])).bit_count() <= 4
    }
    got = {(int(i), int(j)) for a, b in kernels.close_pairs(values, values, 4, tile=37) for i, j in zip(a, b)}
    assert got == want


@pytest.mark.parametrize("seed, hot", [(0, 1000), (1, 10), (2, 1)])
def test_components_equal_plain_union(spark, monkeypatch, seed, hot):
    """With all nodes hot, a few, and none."""
    monkeypatch.setattr(components, "_MOST_HOT", hot)
    draw = random.Random(seed)
    n = 120
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)]
    edges += [(500, i) for i in range(501, 560)] + [(900, 900)]
    groups = Groups(1000)
    for a, b in edges:
        groups.join(a, b)
    want = sorted({(x, groups.root(x)) for e in edges for x in e})
    found = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert sorted((r["node"], r["root"]) for r in found) == want


def test_ends_of_hot_nodes_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(components, "_MOST_HOT", 10)
    rows = [(1, i) for i in range(300)] + [(u, 2 * u) for u in range(2, 702)]
    ends = spark.createDataFrame(rows, "u bigint, v bigint")
    least = ends.selectExpr("u", "v").groupBy("u").agg({"v": "min", "*": "count"}).toDF("u", "m", "n")
    joined = components.with_least(ends, least, 1000)
    want = [(1, i, 0) for i in range(300)] + [(u, 2 * u, 2 * u) for u in range(2, 702)]
    assert sorted(tuple(r) for r in joined.select("u", "v", "m").collect()) == sorted(want)
    # no shuffle between the ends of node 1 and the result: each input partition keeps its part
    whole = components.with_least(ends.where("u = 1").repartition(4, "v"), least, 1000)
    held = whole.rdd.glom().map(len).collect()
    assert sum(held) == 300 and max(held) < 150


def test_components_of_no_edges(spark):
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []


def test_a_hot_component_and_hot_copies(spark):
    """Most rows in one component, many of them exact copies, among more than a thousand others."""
    words = ["w%d" % i for i in range(300)]
    near = [" ".join(words[: 280 + i % 7]) for i in range(40)]
    rows = [(5000 - i, near[i % 40]) for i in range(1500)] + [(i, f"own text number {i} of its kind {i * 7}") for i in range(1200)]
    rows += [(None, near[0]), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = {}
    for r in found:
        prints.setdefault(r["component_id"], set()).add(int(r["fingerprint"], 16))
    of_near = {r["component_id"] for r in found if r["doc_id"] is not None and r["doc_id"] > 3500}
    # reachable by links of four bits or fewer, and every component apart from all others
    everything = sorted({p for s in prints.values() for p in s})
    root = {p: p for p in everything}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(everything):
        for b in everything[:i]:
            if (a ^ b).bit_count() <= 4 and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert len({top(p) for p in everything}) == len(prints)
    assert all(len({top(p) for p in s}) == 1 for s in prints.values())
    assert all(c is None or c <= 5000 for c in of_near)
