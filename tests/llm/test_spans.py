import re
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from groveline.llm import cutting, spans

UNIT = re.compile(r"[^.!?,;:\n]+[.!?,;:]*\n?|[.!?,;:\n]+")
MASK = (1 << 64) - 1


def word_hash(word):
    """The polynomial of a word's characters, with its bits mixed."""
    x = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(word)) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def lowered(text):
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def plain_units(text, longest):
    """(start, end, words) of each unit, one after the other, without numpy."""
    units = []
    for found in UNIT.finditer(text):
        start, end = found.span()
        words = lowered(found.group()).split()
        if not words:
            if units:
                units[-1] = (units[-1][0], end, units[-1][2])
            continue
        cuts = {0}
        if len(words) > longest:
            width = longest // 2 + 1
            hashes = [word_hash(w) for w in words]
            for i in range(len(words) - width + 1):
                cuts.add(max(range(i, i + width), key=lambda j: (-hashes[j], j)))
        cuts = sorted(cuts)
        places = [m.end() + start for m in re.finditer(r"\S+", found.group())]
        at = start
        for i, j in zip(cuts, [*cuts[1:], len(words)]):
            stop = end if j == len(words) else places[j - 1]
            units.append((at, stop, words[i:j]))
            at = stop
    return units


def numpy_units(text, longest):
    bounds, first, _ = cutting.cut(text, longest)
    places = zip(bounds[:-1].tolist(), bounds[1:].tolist())
    words = [w for u in plain_units(text, longest) for w in u[2]]
    return [(a, b, words[i:j]) for (a, b), i, j in zip(places, first[:-1].tolist(), first[1:].tolist())]


def brute(rows):
    """Each span by itself: the first place keeps it, every other place loses its units."""
    met = defaultdict(set)
    for key, text in rows:
        units = plain_units(text or "", spans.LONGEST)
        for start in range(len(units)):
            for stop in range(start + spans.FEWEST, len(units) + 1):
                words = [w for u in units[start:stop] for w in u[2]]
                if len(words) >= spans.LEAST_WORDS:
                    met[tuple(words)].add((key is None, key or 0, text, start, stop))
                    break
    gone = defaultdict(set)
    for places in met.values():
        for none, key, text, start, stop in sorted(places)[1:]:
            gone[none, key, text] |= set(range(start, stop))
    out = []
    for key, text in rows:
        units = plain_units(text or "", spans.LONGEST)
        lost = gone[key is None, key or 0, text] if text is not None else set()
        kept = "".join(text[a:b] for i, (a, b, _) in enumerate(units) if i not in lost) if lost else text
        out.append((key, kept, len(units), len(lost)))
    return sorted(out, key=repr)


def test_equals_plain_python(spark, corpus, edge):
    rows = [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["text"], r["n_sentences"], r["n_removed"]) for r in spans.drop_repeated_spans(corpus).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_edges(edge, empty, edge_rows):
    found = spans.drop_repeated_spans(edge).collect()
    assert len(found) == len(edge_rows)
    ones = [r for r in found if r["doc_id"] == 1]
    twos = [r for r in found if r["doc_id"] == 2]
    assert [r["n_removed"] for r in ones] == [0]
    # rows that repeat key and text lose the same units
    assert len(twos) == 2 and twos[0] == twos[1] and twos[0]["first_docs"] == [1] and twos[0]["n_removed"] > 0
    assert all(r["text"] is None for r in found if r["doc_id"] in (4, 5) and r["n_sentences"] == 0 and r["doc_id"] == 4)
    assert spans.drop_repeated_spans(empty).collect() == []


def test_planted_passage_goes_from_all_but_the_first(spark):
    import random

    draw = random.Random(2)

    def prose(n):
        words = ["v%d" % draw.randrange(500) for _ in range(n)]
        return " ".join(w + draw.choice(["", "", "", "", "", ".", ","]) for w in words)

    passage = prose(60)
    docs = [(i, f"{prose(40)} {passage} {prose(40)}") for i in range(5)] + [(9, prose(200))]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in spans.drop_repeated_spans(table).collect()}
    assert found[0]["n_removed"] == 0 and found[9]["n_removed"] == 0
    for i in range(1, 5):
        lost = len(dict(docs)[i].split()) - len(found[i]["text"].split())
        assert 25 <= lost <= 60 and 0 in found[i]["first_docs"]


@given(st.text(alphabet="ab .,!?\n\t;", max_size=200), st.integers(1, 4))
def test_units_cut_the_text_without_a_gap(text, longest):
    units = numpy_units(text, longest)
    assert units == plain_units(text, longest)
    for (_, end, _), (start, _, _) in zip(units, units[1:]):
        assert start == end
    assert all(1 <= len(u[2]) <= longest for u in units)
    assert [w for u in units for w in u[2]] == text.lower().split() or any(c in text for c in ".,!?;")


def test_passages_of_51_words_hold_a_run_at_any_offset():
    import random

    draw = random.Random(9)

    def prose(n):
        return ["".join(draw.choices("abcdefghij", k=5)) for _ in range(n)]

    def hashes(words):
        _, first, own = cutting.cut(" ".join(words), spans.LONGEST)
        return set(cutting.spans(first, own, spans.FEWEST, spans.LEAST_WORDS)[1].tolist())

    for ends in ([], [30], [12, 39], [12, 24, 39], [13, 38], [14, 26, 37]):
        for _ in range(40):
            passage = prose(51)
            for end in ends:
                passage[end - 1] += "."
            for before in (0, 1, 5, 7, 11):
                first = hashes(prose(draw.randrange(30)) + passage + prose(draw.randrange(30)))
                assert first & hashes(prose(before) + passage + prose(draw.randrange(30)))


def test_cutting_equals_plain_python(corpus, edge_rows):
    odd = ["...a", "a.\n\n.b", "\n\n", "a b. \n\n,c", " . a", "3.14 and\n\n\n!! b", "a\n.b", "İ. b ẞ ΣΑΣ\u2003x\x1cy", "😀 a\x00b"]
    odd += [r[1] for r in edge_rows if r[1]]
    for text in odd + [r["text"] for r in corpus.select("text").collect()]:
        for longest in (4, spans.LONGEST):
            assert numpy_units(text, longest) == plain_units(text, longest)


def test_runs_are_the_shortest_long_enough():
    text = "a b c. " * 9 + "d e f g h i j k l m n o. " * 3
    _, first, hashes = cutting.cut(text, spans.LONGEST)
    units, found = cutting.spans(first, hashes, 3, 20)
    sizes = [3] * 9 + [12] * 3
    shortest = [
        next((k for k in range(3, 13 - i) if sum(sizes[i : i + k]) >= 20), None) for i in range(len(sizes))
    ]
    assert units.tolist() == shortest[: len(units)] == [7, 7, 7, 7, 6, 5, 4, 4, 3, 3]
    assert shortest[len(units) :] == [None, None]
    # the repeated sentences make equal runs, all others differ
    assert len(set(found.tolist())) == 8 and found[0] == found[1] == found[2]


def test_a_hot_passage_meets_its_first_place_by_broadcast(spark):
    """A passage in every row, null and repeated keys, and more rows than hashes may be hot."""
    passage = "one two three four five six seven, eight nine ten eleven twelve thirteen. fourteen fifteen sixteen seventeen eighteen nineteen twenty."
    rows = [(i % 1500 if i % 9 else None, f"{passage} own {i} words.") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], r["text"], r["n_sentences"], r["n_removed"]) for r in spans.drop_repeated_spans(table).collect()]
    assert sorted(got, key=repr) == brute(rows)
    assert sum(r[3] == 0 for r in got) == 1
