import hashlib
import re
from collections import Counter, defaultdict

from groveline.llm import lines, queries

BLANKS = " \t\n\x0b\x0c\r"


def copies(rows):
    """For every row the name that exact and near copies on its host share."""

    words_by, orders = (1540483477, 668265263, 374761393, 1172035187, 1118997045), (
        1, 2177342782468422677, 4354685564936845355, 2685821657736338717
    )

    def minima(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        values = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in words]
        runs = [values[i : i + 5] for i in range(max(1, len(words) - 4))]
        sums = [sum(v * f for v, f in zip(run, words_by)) % 2**64 for run in runs]
        return [min(s * m % 2**64 for s in sums) for m in orders]

    values = [minima(text) for *_, text in rows]
    names = [v[0] for v in values]
    for k in (1, 2, 3, 0):
        least = {}
        for (_, host, _), v, name in zip(rows, values, names):
            least[host, v[k]] = min(name, least.get((host, v[k]), name))
        names = [least[host, v[k]] for (_, host, _), v in zip(rows, values)]
    return names


def brute(rows, ratio, min_pages, once=False):
    pages, on = Counter(), defaultdict(Counter)
    bodies = {}
    for i, ((_, host, text), name) in enumerate(zip(rows, copies(rows) if once else range(len(rows)))):
        if host is not None:
            bodies.setdefault((host, name), set()).update({x.strip(BLANKS) for x in (text or "").split("\n")} - {""})
    for (host, _), lines_of in bodies.items():
        pages[host] += 1
        on[host].update(lines_of)
    out = []
    for key, host, text in rows:
        kept = [
            x
            for x in (text or "").split("\n")
            if not (
                x.strip(BLANKS)
                and host is not None
                and on[host][x.strip(BLANKS)] >= min_pages
                and on[host][x.strip(BLANKS)] > ratio * pages[host]
            )
        ]
        n = len((text or "").split("\n")) - len(kept)
        out.append((key, text if n == 0 else "\n".join(kept), n if text is not None else 0))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def test_equals_plain_python(spark, corpus, edge):
    made = [(i, "h%d" % (i % 3) if i % 7 else None, f"menu \n\nbody {i}\n  menu\nfoot {i % 5}") for i in range(60)]
    made += [(None, "h0", None), (None, "h0", ""), (1, "h0", "menu"), (1, "h0", "menu")]
    docs = spark.createDataFrame(made, "doc_id bigint, source string, text string")
    for table, ratio, least in ((docs, 0.3, 3), (docs, 0.1, 2), (corpus, 0.08, 3), (edge, 0.2, 2)):
        rows = [(r["doc_id"], r["source"], r["text"]) for r in table.select("doc_id", "source", "text").collect()]
        for once in (False, True):
            found = lines.drop_boilerplate(table, ratio=ratio, min_pages=least, copies_once=once)
            got = [(r["doc_id"], r["text"], r[lines.ADDED]) for r in found.collect()]
            assert ordered(got) == ordered(brute(rows, ratio, least, once))
            assert found.columns == [*table.columns, lines.ADDED]


def test_the_query_equals_plain_python(spark):
    """As registered, on all rows of a larger table."""
    path = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = [(r["doc_id"], r["text"], r[lines.ADDED]) for r in queries.op7_line_dedup(spark, path).collect()]
    assert ordered(got) == ordered(brute(rows, lines.RATIO, lines.MIN_PAGES, True))
    assert sum(r[2] for r in got) > 50


def test_lines_just_above_and_below_the_ratio(spark):
    """Of 100 pages 9 hold one line and 8 the other; copies of those change nothing."""
    rows = [(i, "h", f"own {i}\n" + "over\n" * (i < 9) + "under\n" * (i < 8) + "end") for i in range(100)]
    rows += [(200 + i, "h", rows[0][2]) for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = lines.drop_boilerplate(table, copies_once=True)
    got = [(r["doc_id"], r["text"], r[lines.ADDED]) for r in found.collect()]
    assert ordered(got) == ordered(brute(rows, 0.08, 3, True))
    assert {r[0]: r[1] for r in got}[200] == "own 0\nunder\n"[:-1]


def test_hosts_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "_BROADCAST_LINES", 0)
    monkeypatch.setattr(lines, "_MOST_HOT", 4)
    hosts = ["hot"] * 60 + [f"h{i % 9}" for i in range(60)] + [None] * 9
    rows = [(i, h, f"menu of {h}\nbody {i}\nfoot") for i, h in enumerate(hosts)]
    table = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = lines.drop_boilerplate(table)
    assert ordered((r["doc_id"], r["text"], r[lines.ADDED]) for r in found.collect()) == ordered(brute(rows, 0.08, 3))
    assert found.columns == [*table.columns, lines.ADDED]


def test_column_of_the_added_name_is_replaced(edge, empty):
    from pyspark.sql import functions as F

    found = lines.drop_boilerplate(edge.withColumn(lines.ADDED, F.lit("mine")))
    assert found.columns.count(lines.ADDED) == 1 and isinstance(found.first()[lines.ADDED], int)
    assert lines.drop_boilerplate(empty).collect() == []


def test_a_hot_group_of_copies_keeps_its_text(spark, tmp_path):
    import random

    import corpus_pipeline

    draw = random.Random(7)

    def prose(n):
        return " ".join("".join(draw.choices("abcdefghijklmnop", k=6)) for _ in range(n))

    clean = [prose(150) for _ in range(4)]
    near = [prose(200) for _ in range(3)]
    texts = ["\n".join(["menu line", *clean])] * 20
    for k in range(20):  # near copies: one word of one line differs
        changed = near[k % 3].rsplit(" ", 1)[0] + f" other{k}"
        texts.append("\n".join(["menu line", *near[: k % 3], changed, *near[k % 3 + 1 :]]))
    texts += [f"menu line\n{prose(80)}" for _ in range(30)]
    docs = spark.createDataFrame(
        [(i, t, "en", "h", len(t)) for i, t in enumerate(texts)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = [t.removeprefix("menu line\n") for t in texts]
    got = {r["doc_id"]: r["text"] for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    cut = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    left = {r["text"] for r in corpus_pipeline.near_dedup(spark, cut, str(tmp_path)).collect()}
    assert want[0] in left and left & set(want[20:40]) and set(want[40:]) <= left and "" not in left
