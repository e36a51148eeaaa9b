import random
import re
import time
from collections import Counter

from groveline.llm import decontaminate


def shingles(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(docs, items, similarity=0.8):
    """All windows of an item's size that touch the text, cut at its ends."""
    found = {}
    for key, text in docs:
        own = shingles(text)
        for name, item in items:
            given = Counter(shingles(item))
            size = given.total()
            if len([g for g in own if g in given]) < similarity * size or not size:
                continue
            for at in range(1 - size, len(own)):
                start, stop = max(at, 0), min(at + size, len(own))
                window = Counter(own[start:stop])
                share = (window & given).total() / (window | given).total()
                if share >= similarity:
                    best = found.get((key, name), (0, 0, 0))
                    found[key, name] = max(best, (share, start, -stop))
    return {(k, n, s, round(v, 6)) for (k, n), (v, s, _) in found.items()}


def got(spark, docs, items, **options):
    a = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.contaminated(a, b, **options).collect()
    return {(r["doc_id"], r["item_id"], r["start_word"], round(r["similarity"], 6)) for r in rows}


def cases(seed=3):
    draw = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]

    def prose(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    items = [prose(n) for n in (4, 5, 12, 30, 45, 45, 60, 80)] + [["same"] * 20]
    docs = []
    for k, item in enumerate(items * 4):
        text = list(item)
        for _ in range(k % 4):  # some edits: a word changed, put in or left out
            at = draw.randrange(len(text))
            text[at : at + draw.choice([0, 1, 1])] = draw.choice([[], ["new"], ["odd"]])
        docs.append((k, " ".join(prose(draw.randrange(60)) + text + prose(draw.randrange(60))).title()))
    docs += [(100, " ".join(prose(500))), (101, ""), (102, None), (None, " ".join(items[3]))]
    docs += [(103, ", ".join(items[4] + items[5])), (103, " ".join(items[6])), (103, " ".join(items[6]))]
    docs += [(104, " ".join(items[7][:70]))]
    named = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (None, " ".join(items[2]))]
    return docs, named


def test_equals_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    assert any(v < 1 for *_, v in want) and any(v == 1 for *_, v in want)


def test_without_broadcast(spark, monkeypatch):
    docs, items = cases(4)
    monkeypatch.setattr(decontaminate, "_BROADCAST_ROWS", 0)
    assert got(spark, docs, items) == brute(docs, items)


def test_index_guarantees_the_radius(spark):
    draw = random.Random(5)
    pairs = []
    for i in range(200):
        a, flips = draw.getrandbits(64), draw.sample(range(64), draw.randrange(0, 26))
        pairs.append((i, a, a ^ sum(1 << b for b in flips), len(flips)))

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    windows = spark.createDataFrame([(i, 7, signed(a)) for i, a, _, _ in pairs], "w int, size int, fp bigint")
    items = spark.createDataFrame([(i, 7, signed(b)) for i, _, b, _ in pairs], "item int, size int, fp bigint")
    found = {(r["w"], r["item"]) for r in decontaminate.near_items(windows, items).collect()}
    for i, _, _, distance in pairs:
        assert ((i, i) in found) == (distance <= decontaminate.RADIUS)


def test_drop_keeps_clean_rows_whole(spark, edge, empty):
    benchmark = spark.createDataFrame(
        [(1, "nobody had seen the ferry since spring it was said that the captain had sold it")],
        "item_id bigint, text string",
    )
    kept = decontaminate.drop_contaminated(edge, benchmark)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 2**62]
    assert decontaminate.contaminated(empty, benchmark).collect() == []
    assert len(decontaminate.drop_contaminated(edge, benchmark.limit(0)).collect()) == edge.count()


def test_no_python(spark, edge):
    benchmark = spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, text string")
    plan = decontaminate.contaminated(edge, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def slid(docs, items, similarity=0.8):
    """(document, item, similarity) over every window of the item's size in the text."""
    found = set()
    for key, text in docs:
        own = shingles(text)
        for name, item in items:
            given = Counter(shingles(item))
            size = given.total()
            best = 0
            for start in range(max(len(own) - size, 0) + 1):
                window = Counter(own[start : start + size])
                best = max(best, (window & given).total() / (window | given).total())
            if best >= similarity:
                found.add((key, name, round(best, 6)))
    return found


def test_moved_parts_and_repeated_shingles(spark):
    draw = random.Random(11)

    def prose(n):
        return ["x%d" % draw.randrange(10**6) for _ in range(n)]

    def around(words):  # in mid-text, where no window is cut at an end
        return " ".join(prose(100) + words + prose(100))

    a, b = prose(30), prose(30)
    items, docs = [(0, " ".join(a + b))], [(0, around(b + a))]
    for k in range(1, 25):  # a run of one word in place of the last tenth
        item = prose(94)
        items.append((k, " ".join(item)))
        docs.append((k, around(item[:85] + ["run"] * 9)))
        items.append((100 + k, " ".join(item[:80] + ["run"] * 14)))
    want = slid(docs, items)
    assert len([w for w in want if w[0] == w[1]]) == 25 and len(want) == 49
    assert {(d, i, s) for d, i, _, s in got(spark, docs, items)} == want


def test_long_items_with_repeated_words_take_seconds(spark):
    """Linear in the item: 20,000 words, of one word, of a few, and all different."""
    draw = random.Random(1)
    same, few, apart = ["word"] * 20_000, [draw.choice("abc") for _ in range(20_000)], ["v%d" % i for i in range(20_000)]
    items = [(i, " ".join(w)) for i, w in enumerate((same, few, apart))]
    docs = [(i, " ".join(["lead", "in", *w[1000:], "end"])) for i, w in enumerate((same, few, apart))]
    docs.append((9, " ".join(apart[:9000])))
    start = time.time()
    found = got(spark, docs, items)
    assert {(d, i) for d, i, *_ in found} == {(0, 0), (1, 1), (2, 2)}
    assert all(0.94 < s < 0.951 for *_, s in found)
    assert time.time() - start < 120


def test_the_plan_goes_by_fingerprints(spark, monkeypatch):
    """Distinct shingles reach the comparison through the multi-index alone."""
    item = ["u%d" % i for i in range(60)]
    docs = [(1, " ".join(["x%d" % i for i in range(50)] + item[:56] + ["other", "end"]))]
    assert {r[:2] for r in got(spark, docs, [(1, " ".join(item))])} == {(1, 1)}
    calls = []
    near = decontaminate.near_items
    monkeypatch.setattr(decontaminate, "near_items", lambda w, i, r: calls.append(r) or near(w, i, r).limit(0))
    assert got(spark, docs, [(1, " ".join(item))]) == set() and calls == [decontaminate.RADIUS]


def test_repeated_shingles_have_their_own_way(spark, monkeypatch):
    """Where the counts of one shingle differ the fingerprints are far apart."""
    near = decontaminate.near_items
    monkeypatch.setattr(decontaminate, "near_items", lambda w, i, r: near(w, i, r).limit(0))
    item = ["u%d" % i for i in range(70)] + ["run"] * 12
    docs = [(1, " ".join(item[:72])), (2, " ".join(item[:70] + ["run"] * 16))]
    assert got(spark, docs, [(1, " ".join(item))]) == brute(docs, [(1, " ".join(item))]) != set()
