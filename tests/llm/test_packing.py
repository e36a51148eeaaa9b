import random
from collections import defaultdict

from groveline.llm import kernels, packing


def brute_best_fit(lengths, sources, clusters, capacity):
    bins = []
    placed = []
    for n, s, c in zip(lengths, sources, clusters):
        fitting = [
            (room, i)
            for i, (room, held, groups) in enumerate(bins)
            if room >= n and (s < 0 or s not in held) and (c < 0 or c not in groups)
        ]
        if fitting:
            _, i = min(fitting)
        else:
            bins.append((capacity, set(), set()))
            i = len(bins) - 1
        room, held, groups = bins[i]
        placed.append((i, capacity - room))
        bins[i] = (room - n, held | {s}, groups | {c})
    return placed


def test_search_equals_a_scan_of_all_bins():
    draw = random.Random(1)
    for _ in range(20):
        n = 200
        lengths = [draw.randrange(0, 101) for _ in range(n)]
        sources = [draw.choice([-1, 0, 0, 0, 1, 2, 3, 4]) for _ in range(n)]
        clusters = [draw.choice([-1, -1, 0, 1, 2]) for _ in range(n)]
        args = (lengths, sources, clusters, 100)
        assert kernels.best_fit(*args) == brute_best_fit(*args)


def check(docs, capacity, **options):
    found = packing.pack(docs, capacity, **options).collect()
    texts = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    # every word of every text once
    want = defaultdict(int)
    for key, text, _ in texts:
        n = len((text or "").split())
        for p in range(max(1, -(-n // capacity))):
            want[key, p, p * capacity, min(capacity, n - p * capacity)] += 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in found:
        have[r["doc_id"], r["piece"], r["start_word"], r["n_words"]] += 1
        bins[r["bin"]].append(r)
    assert have == want
    by_key = {k: (t, s) for k, t, s in texts}
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: (r["offset"], r["n_words"])):
            assert r["offset"] == at
            at += r["n_words"]
        assert at <= capacity
        sources = [by_key[r["doc_id"]][1] for r in held if by_key[r["doc_id"]][1] is not None]
        assert len(sources) == len(set(sources))
        same = [by_key[r["doc_id"]][0] for r in held if by_key[r["doc_id"]][0] is not None]
        assert len(same) == len(set(same))
    return bins


def test_corpus(corpus):
    check(corpus, 300)
    assert len(check(corpus, 2048, group=50)) > 1


def test_edges(edge, empty, spark):
    check(edge, 1000)
    assert packing.pack(empty).collect() == []
    hot = spark.createDataFrame([(1, "a b c", "s")] * 300, "doc_id bigint, text string, source string")
    assert len(check(hot, 10, group=40)) == 300


def test_cluster_column(spark):
    rows = [(i, "w " * 3, None, i % 2) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, grp int")
    found = packing.pack(docs, 100, cluster="grp").collect()
    bins = defaultdict(list)
    for r in found:
        bins[r["bin"]].append(r["doc_id"] % 2)
    assert sorted(map(sorted, bins.values())) == [[0, 1]] * 5
