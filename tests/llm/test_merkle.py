import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from groveline.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(leaves):
    """All levels, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        under = levels[-1]
        levels.append([h(*under[i : i + 3]) for i in range(0, len(under), 3)])
    return levels


def steps(levels, i):
    """What stands before and after the ancestor of leaf ``i`` in its run, upwards."""
    found = []
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        found.append((run[: i % 3], run[i % 3 + 1 :]))
        i //= 3
    return found


def brute(rows):
    sources = defaultdict(list)
    for row in rows:
        sources[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row, row["text"]), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        sources[source].sort(key=lambda x: x[:3])
        trees[source] = tree([x[2] for x in sources[source]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for s, source in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(sources[source]):
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            proof, folded = [], leaf_of(row, text)
            for before, after in steps(trees[source], i) + steps(top, s):
                proof += before + after
                folded = h(*before, folded, *after)
            root = top[-1][0]
            out.append((row["doc_id"], leaf, trees[source][-1][0], root, h(*proof), folded, folded == root))
    return sorted(out, key=repr)


def both(table):
    rows = [r.asDict() for r in table.collect()]
    got = [tuple(r) for r in merkle.manifest(table, tampered=merkle.line_breaks_deleted).collect()]
    assert sorted(got, key=repr) == brute(rows)
    return got


def test_equals_plain_python(spark, corpus, edge):
    assert {r[-1] for r in both(corpus)} == {True, False}
    both(edge)


def test_sizes_of_trees(spark):
    """A lone leaf, full and partly filled runs, more leaves than a record has, repeated rows."""
    made = []
    for source, n in (("a", 1), ("b", 3), ("c", 4), ("d", 82), ("é", 250), (None, 10), ("", 2), ("B", 28)):
        made += [(i * 7 % 101, source, "en", i, f"line {i}\nmore" if i % 3 else None) for i in range(n)]
    made += [(5, "same", "en", 1, "copy\n")] * 100
    table = spark.createDataFrame(made, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert len(both(table)) == len(made)


def test_single_row_and_empty_table(spark, empty):
    one = spark.createDataFrame([(2, None, None, None, "")], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    found = merkle.manifest(one).first()
    assert found["leaf"] == found["subroot"] == found["root"] == h("1:2---0:")
    assert found["proof_sha256"] == h("") and found["verified"]
    assert merkle.manifest(empty).collect() == []


def test_an_honest_table_verifies_and_any_change_shows(spark, corpus):
    assert merkle.manifest(corpus).where(~F.col("verified")).count() == 0
    changed = merkle.manifest(corpus, tampered=lambda k, t: F.when(k == 7, F.concat(t, F.lit("!"))).otherwise(t))
    assert [r["doc_id"] for r in changed.where(~F.col("verified")).collect()] == [7]


def test_the_query_covers_every_document(spark, small, corpus):
    found = queries.op11_merkle_manifest(spark, small)
    assert found.count() == corpus.count() and found.select("root").distinct().count() == 1
